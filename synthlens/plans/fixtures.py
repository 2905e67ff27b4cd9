"""Fixtures on the driver's tables, each defined twice: as a Spark
DataFrame and as SQL text (a CTE body) so the DuckDB oracle builds the same
input. Every fixture uses whole tables.

- ``flows``     lineitem as a feature table: ``grp`` = l_linestatus (F real,
                O other), label ``ssh`` when l_returnflag = 'R'.
- ``dirty``     events with NaN, +inf, -inf and NULL planted in ``value``.
- ``packets``   events as packets: session = user_id, sent for click,
                purchase and signup events.
- ``conns``     lineitem as connections: destination = supplier,
                source = part.
- ``preds``     orders as predictions per endpoint ``<custkey>:22``; every
                tenth order is at the exempt endpoint of synthetic rows.
- ``responses`` events as recorded model replies, 20 objects per batch
                (batch = event_id div 20 + 1), in
                six reply shapes (plain, fenced, prose, truncated, trailing
                text, no array). Every 50th object lacks ``f2``, in every
                77th ``f1`` is 100 times too large.
- ``full``      the replies that hold all their objects (shapes 0 to 2),
                numbered from 1 without a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
REPLY_FEATURES = ["f1", "f2"]
REPLY_BATCH = 20
SENT_TYPES = ("click", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("grp"),
                     F.when(F.col("l_returnflag") == "R", "ssh").otherwise("non-ssh").alias("label"),
                     *[F.col(f).cast("double").alias(f) for f in FLOW_FEATURES])


FLOWS_SQL = ("SELECT l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 'ssh' ELSE 'non-ssh' END AS label, "
             + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FLOW_FEATURES) + " FROM lineitem")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    v = (F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 101 == 0, F.lit(float("inf")))
         .when(i % 103 == 0, F.lit(float("-inf"))).when(i % 89 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")))
    return ev.select("event_id", "user_id", "event_type", v.alias("value"))


DIRTY_SQL = ("SELECT event_id, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE "
             "WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE WHEN event_id % 103 = 0 THEN '-inf'::DOUBLE "
             "WHEN event_id % 89 = 0 THEN NULL ELSE value END AS value FROM events")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("session"), F.col("event_id").alias("pid"), "ts",
                     F.col("value").alias("bytes"), F.col("event_type").isin(*SENT_TYPES).alias("sent"))


PACKETS_SQL = ("SELECT user_id AS session, event_id AS pid, ts, value AS bytes, event_type IN ("
               + ", ".join(f"'{t}'" for t in SENT_TYPES) + ") AS sent FROM events")


def conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("src"))


CONNS_SQL = "SELECT l_suppkey AS dst, l_partkey AS src FROM lineitem"


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    dummy = F.col("o_orderkey") % 10 == 0
    return o.select("o_orderkey", "o_orderdate", "o_orderpriority",
                    F.when(dummy, "255.255.255.255").otherwise(F.col("o_custkey").cast("string")).alias("Destination"),
                    F.when(dummy, 1).otherwise(22).alias("Destination Port"),
                    F.when(F.col("o_orderstatus") == "F", "ssh").otherwise("non-ssh").alias("truth"),
                    F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ssh").otherwise("non-ssh")
                    .alias("prediction"))


PREDS_SQL = ("SELECT o_orderkey, o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN '255.255.255.255' "
             "ELSE CAST(o_custkey AS VARCHAR) END AS \"Destination\", CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 22 END "
             "AS \"Destination Port\", CASE WHEN o_orderstatus = 'F' THEN 'ssh' ELSE 'non-ssh' END AS truth, "
             "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ssh' ELSE 'non-ssh' END AS prediction "
             "FROM orders")

# Fixed texts of the six reply shapes.
PROSE_BEFORE = "Here are the records you asked for: "
PROSE_AFTER = " Let me know if you need more."
TRAILER = " and [2]"
BROKEN = '{"f1":12345'
REFUSAL = "Sorry, I cannot produce that."


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    f1 = F.round(F.col("value") * 100).cast("bigint") * F.when(F.col("event_id") % 77 == 0, 100).otherwise(1)
    f2 = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit(', "f2": '), F.col("user_id").cast("string")))
    obj = F.concat(F.lit('{"f1": '), f1.cast("string"), f2, F.lit("}"))
    per = (ev.select((F.floor(F.col("event_id") / REPLY_BATCH) + 1).cast("bigint").alias("batch"), "event_id",
                     obj.alias("obj"))
           .groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "obj"))),
                                             lambda s: s["obj"]).alias("objs")))
    body = F.array_join("objs", ",")
    head = F.array_join(F.slice("objs", 1, F.size("objs") - 1), ",")
    mode = F.col("batch") % 6
    resp = (F.when(mode == 0, F.concat(F.lit("["), body, F.lit("]")))
            .when(mode == 1, F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
            .when(mode == 2, F.concat(F.lit(PROSE_BEFORE + "["), body, F.lit("]" + PROSE_AFTER)))
            .when(mode == 3, F.concat(F.lit("["), head, F.when(F.size("objs") > 1, F.lit(",")).otherwise(F.lit("")),
                                      F.lit(BROKEN)))
            .when(mode == 4, F.concat(F.lit("["), body, F.lit("]" + TRAILER)))
            .otherwise(F.lit(REFUSAL)))
    return per.select("batch", resp.alias("response"))


REPLY_F1_SQL = "CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 77 = 0 THEN 100 ELSE 1 END"
REPLY_F2_SQL = "CASE WHEN event_id % 50 <> 0 THEN user_id END"
RESPONSES_SQL = f"""SELECT batch, CASE batch % 6
    WHEN 0 THEN '[' || body || ']'
    WHEN 1 THEN '```json' || chr(10) || '[' || body || ']' || chr(10) || '```'
    WHEN 2 THEN '{PROSE_BEFORE}[' || body || ']{PROSE_AFTER}'
    WHEN 3 THEN '[' || coalesce(head, '') || CASE WHEN c > 1 THEN ',' ELSE '' END || '{BROKEN}'
    WHEN 4 THEN '[' || body || ']{TRAILER}'
    ELSE '{REFUSAL}' END AS response
  FROM (SELECT batch, count(*) AS c, string_agg(obj, ',' ORDER BY event_id) AS body,
               string_agg(CASE WHEN rn < c THEN obj END, ',' ORDER BY event_id) AS head
        FROM (SELECT batch, event_id, obj, row_number() OVER (PARTITION BY batch ORDER BY event_id) AS rn,
                     count(*) OVER (PARTITION BY batch) AS c
              FROM (SELECT CAST(floor(event_id / {REPLY_BATCH}) AS BIGINT) + 1 AS batch, event_id,
                           '{{"f1": ' || CAST({REPLY_F1_SQL} AS VARCHAR) || CASE WHEN event_id % 50 = 0 THEN ''
                           ELSE ', "f2": ' || CAST(user_id AS VARCHAR) END || '}}' AS obj FROM events))
        GROUP BY batch)"""


def full_number(batch):
    """Number of a reply among those of the first three shapes."""
    return (F.floor(batch / 6) * 3 + batch % 6).cast("bigint")


def real_reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 'real' records the replies are judged against: purchase events."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(F.round(F.col("value") * 100).alias("f1"), F.col("user_id").cast("double").alias("f2"))


REAL_REPLY_SQL = ("SELECT CAST(round(value * 100) AS DOUBLE) AS f1, CAST(user_id AS DOUBLE) AS f2 "
                  "FROM events WHERE event_type = 'purchase'")
