"""Synthesis from a statistics profile.

The generator's sequential loop (one model call per batch, a running total
that sets the next request size) has a closed form: with parsed counts
``p_k`` and batch size ``B`` the accepted total after batch ``k`` is
``min(n, sum_{j<=k} min(p_j, B))``. So every batch is a row, replies are a
table, and the loop is a running sum. The running sum is taken in blocks, and
over the block totals likewise, so no task sees all batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.functions.numeric import finite_or_null, greatest_of, md5_normal, md5_unit
from synthlens.functions.text import fmt4, parse_replies
from synthlens.operators.clean import clip_to_profile, drop_incomplete, require_features
from synthlens.operators.joins import join_checked
from synthlens.operators.sampling import cap_rows
from synthlens.sources.files import path_exists

RULE = "-" * 64


@dataclass(frozen=True)
class FeatureSpec:
    key: str
    name: str
    description: str


# Our wording of the session-feature relations the prompt carries.
SESSION_RELATIONS = """Relations the records must respect (values are log-scaled to 0-100):
R1 average connections per source = total connections / distinct sources; many connections from few
   sources means concentrated access, few connections from many sources means scanning.
R2 transmit speed = bytes sent / session duration; large transfers in short sessions are fast.
R3 transmit/receive ratio = bytes sent / bytes received; interactive work sits near 0.3-0.7,
   uploads above 1.0, scripted remote commands near 0.1-0.3.
R4 mean inter-arrival gap = sum of the N-1 gaps / (N-1).
R5 gap variance = sum of squared deviations of the gaps / (N-1).
R6 session duration is about (N-1) x mean gap: longer sessions need longer gaps or more packets.
Human-paced sessions have long, irregular gaps; scripted and transfer sessions have short, steady
gaps, and transfers move many bytes at high speed. Records breaking a relation are invalid."""

SYSTEM_TEXT = """You generate synthetic network-session feature records for security research.
Answer with one JSON array and nothing else: no prose, no markdown.
Every object has exactly the feature keys listed in the request, each a positive number inside
the stated range; the relations given must hold; do not repeat records; no addresses or payloads."""


def running_total(df: DataFrame, order_col: str, value_col: str, out: str, block: int = 65_536,
                  max_key: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` in ``order_col`` order (a
    non-negative integer key). Keys fall into blocks of ``block``; inside a
    block a window sums, and the totals of the blocks before are the running
    sum of the block totals, found the same way one level up, until one block
    holds all keys. So no window holds more than ``block`` keys (65,536:
    three levels up to 2^48 keys). ``max_key``: the largest key, if known."""
    if max_key is None:
        max_key = df.agg(F.max(order_col)).first()[0] or 0
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)).cast("bigint"))
    w = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(value_col).over(w)
    if max_key < block:
        return d.withColumn(out, inside.cast("bigint")).drop("_blk")
    totals = d.groupBy("_blk").agg(F.sum(value_col).alias("_bs"))
    offsets = (running_total(totals.withColumnRenamed("_blk", "_key"), "_key", "_bs", "_upto", block, max_key // block)
               .select(F.col("_key").alias("_blk"), (F.col("_upto") - F.col("_bs")).alias("_off")))
    return (join_checked(d, offsets, "_blk")
            .withColumn(out, (F.col("_off") + inside).cast("bigint")).drop("_blk", "_off"))


def batch_plan(spark: SparkSession, n: int, batch_size: int) -> DataFrame:
    """``ceil(n/B)`` batches; the static request is ``min(B, n - (k-1)B)``."""
    nb = -(-int(n) // int(batch_size))
    return (spark.range(1, nb + 1).select(F.col("id").alias("batch"))
            .withColumn("request_n", F.least(F.lit(batch_size), F.lit(n) - (F.col("batch") - 1) * batch_size)
                        .cast("bigint"))
            .withColumn("n_batches", F.lit(nb).cast("bigint")))


def batch_accounting(parsed: DataFrame, n: int, batch_size: int) -> DataFrame:
    """Input ``(batch, parsed)`` (failed batches parsed 0 or absent);
    output ``(batch, parsed, requested, accepted, total)`` where ``requested``
    is 0 once the target is met (the loop has stopped)."""
    spark = parsed.sparkSession
    plan = batch_plan(spark, n, batch_size).select("batch")
    # a batch that was delivered twice counts once
    once = parsed.groupBy("batch").agg(F.max("parsed").cast("bigint").alias("parsed"))
    d = plan.join(once, "batch", "left").fillna(0, ["parsed"])
    d = d.withColumn("_cap", F.least(F.col("parsed"), F.lit(batch_size)).cast("bigint"))
    d = running_total(d, "batch", "_cap", "_s", max_key=-(-int(n) // int(batch_size)))
    total = F.least(F.lit(n), F.col("_s"))
    before = F.least(F.lit(n), F.col("_s") - F.col("_cap"))
    return d.select("batch", "parsed",
                    F.greatest(F.lit(0), F.least(F.lit(batch_size), F.lit(n) - before)).cast("bigint").alias("requested"),
                    (total - before).cast("bigint").alias("accepted"), total.cast("bigint").alias("total"))


def batch_outcomes(accounting: DataFrame) -> DataFrame:
    """Planned batches, failed batches among those run, accepted rows."""
    ran = F.col("requested") > 0
    return accounting.agg(F.count(F.lit(1)).alias("planned"),
                          F.count_if(ran & (F.col("parsed") == 0)).alias("failed"),
                          F.sum("accepted").cast("bigint").alias("accepted"))


def profile_block(profile: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """One-row text of the profile, features in the given order (F05, F10). A
    feature of the profile without a spec raises."""
    spark = profile.sparkSession
    lookup = spark.createDataFrame([(i, s.key, s.name, s.description) for i, s in enumerate(specs)],
                                   "pos int, feature string, name string, description string")
    missing = F.raise_error(F.concat(F.lit("no spec for the feature "), F.col("feature"))).cast("string")
    lines = profile.join(F.broadcast(lookup), "feature", "left").select("pos", F.concat(
        F.lit("feature "), F.col("feature"), F.lit(" ("), F.when(F.col("pos").isNull(), missing).otherwise(F.col("name")), F.lit("): "), F.col("description"), F.lit("\n"),
        F.lit("  mean "), fmt4(F.col("mean") + F.lit(0.0)), F.lit(", std "), fmt4(F.col("std") + F.lit(0.0)),
        F.lit(", min "), fmt4(F.col("min_v") + F.lit(0.0)), F.lit(", max "), fmt4(F.col("max_v") + F.lit(0.0)),
        F.lit(", quartiles "), fmt4(F.col("q1") + F.lit(0.0)), F.lit(" "), fmt4(F.col("q2") + F.lit(0.0)), F.lit(" "), fmt4(F.col("q3") + F.lit(0.0)),
    ).alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                              lambda s: s["line"]), "\n").alias("profile_text"))


def render_prompt(request_n: Column, batch: Column, n_batches: Column, profile_text: Column,
                  relations: str, keys: Sequence[str]) -> Column:
    """Statistics-only request text (no real record appears)."""
    return F.concat(
        F.lit("Produce "), request_n.cast("string"), F.lit(" synthetic session records as a JSON array (batch "),
        batch.cast("string"), F.lit(" of "), n_batches.cast("string"), F.lit(").\n"),
        F.lit(RULE + "\nProfile of the real sessions (statistics only, no real records):\n"), profile_text,
        F.lit("\n" + RULE + "\n" + relations + "\n" + RULE + "\nReply with a JSON array of "), request_n.cast("string"),
        F.lit(" objects with the keys " + ", ".join(keys) + " and nothing else."))


def prompt_text(profile: DataFrame, specs: Sequence[FeatureSpec], plan: DataFrame,
                relations: str = SESSION_RELATIONS) -> DataFrame:
    """One prompt per planned batch: ``(batch, request_n, prompt)``."""
    block = F.broadcast(profile_block(profile, specs))
    return plan.crossJoin(block).select(
        "batch", "request_n",
        render_prompt(F.col("request_n"), F.col("batch"), F.col("n_batches"), F.col("profile_text"), relations,
                      [s.key for s in specs]).alias("prompt"))


NO_REPLY = "no reply"


def completion_source(prompts: DataFrame, recorded: DataFrame | None = None, completer=None,
                      concurrency: int | None = None) -> DataFrame:
    """Prompt -> reply, and in ``error`` why a call failed (NULL if it
    did not). Either a recorded replies table ``(batch, response)`` (left
    join: a batch without a reply failed), or a callable
    ``completer(system, prompt) -> str`` run in the executors' Python
    workers over Arrow batches of prompts (concurrency bounded by the
    prompt table's partitions; ``concurrency`` repartitions the prompts so at
    most that many calls run at once). A callable's replies are not the same
    when asked again: write the result to a table before it is used twice."""
    if recorded is not None:
        out = prompts.join(recorded.select("batch", "response"), "batch", "left")
        return out.withColumn("error", F.when(F.col("response").isNull(), F.lit(NO_REPLY)))
    if completer is None:
        raise ValueError("give a recorded replies table or a completer")

    def call(batches):
        for pdf in batches:
            out, errors = [], []
            for p in pdf["prompt"]:
                reply = error = None
                try:
                    reply = completer(SYSTEM_TEXT, p)
                except Exception as e:  # a failed call fails only its batch
                    error = f"{type(e).__name__}: {e}"
                out.append(reply)
                errors.append(error or (NO_REPLY if reply is None else None))
            yield pdf.assign(response=out, error=errors)

    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()),
                           T.StructField("error", T.StringType())])
    if concurrency:
        prompts = prompts.repartition(int(concurrency), "batch")
    return prompts.mapInPandas(call, schema)


def resumed_replies(prompts: DataFrame, completer, path: str, per_write: int = 1000, concurrency: int | None = None,
                    ask_failed: bool = False) -> DataFrame:
    """S07 with a memory: ``(batch, response, error)`` of every prompt, kept
    as Parquet under ``path``. Only batches that ``path`` does not hold are
    asked, ``per_write`` batch numbers at a time, and each portion is written
    before the next is asked: a run that ended is started again by the same
    call and loses one portion at most. A failed call is an answer too (its
    reason is kept) and is not asked again unless ``ask_failed``; then a
    batch has one row per attempt there, and the result holds a reply if any
    attempt gave one. Prompts without a batch number cannot be told apart
    and are refused."""
    spark = prompts.sparkSession
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("response", T.StringType()),
                           T.StructField("error", T.StringType())])
    asked = prompts.select(F.col("batch").cast("bigint").alias("batch"), "prompt")
    bounds = asked.agg(F.min("batch"), F.max("batch"), F.count_if(F.col("batch").isNull())).first()
    if bounds[2]:
        raise ValueError("a prompt has no batch number")

    def held() -> DataFrame:
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)

    first = bounds[0]
    while first is not None and first <= bounds[1]:
        here = F.col("batch").between(first, first + per_write - 1)
        done = held().where(here)
        done = done.where(F.col("response").isNotNull()) if ask_failed else done
        due = asked.where(here).join(done.select("batch"), "batch", "left_anti")
        # the next portion starts at the next batch that is there: numbers may have gaps
        if not due.isEmpty():
            replies = completion_source(due, completer=completer, concurrency=concurrency)
            replies.select("batch", "response", "error").write.mode("append").parquet(path)
        first = asked.where(F.col("batch") >= first + per_write).agg(F.min("batch")).first()[0]
    best = held().groupBy("batch").agg(F.max("response").alias("response"), F.max("error").alias("_error"))
    return (asked.select("batch").distinct().join(best, "batch", "left")
            .select("batch", "response", F.when(F.col("response").isNull(), F.col("_error")).alias("error")))


def parsed_items(replies: DataFrame) -> DataFrame:
    """One row per reply: ``(batch, items)``, items = object texts (NULL
    for a non-object array item); a failed reply has none."""
    return parse_replies(replies.select("batch", "response")).select("batch", "items")


def records_from_items(items: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(batch, pos, features...)`` for every parsed array item;
    features of non-object items, quoted numbers, NaN and infinity are NULL."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    # the outer form: the plain one makes Spark infer a filter on the array, which copies the whole parse into it
    exploded = items.select("batch", F.posexplode_outer("items").alias("pos", "item")).where(F.col("pos").isNotNull())
    return exploded.select("batch", F.col("pos").cast("bigint").alias("pos"),
                           F.from_json("item", schema).alias("r")).select(
        "batch", "pos", *[finite_or_null(F.col(f"r.{f}")).alias(f) for f in features])


def records_from_replies(replies: DataFrame, features: Sequence[str]) -> DataFrame:
    return records_from_items(parsed_items(replies), features)


def counts_from_items(items: DataFrame) -> DataFrame:
    return items.select("batch", F.size("items").cast("bigint").alias("parsed"))


def parsed_counts(replies: DataFrame) -> DataFrame:
    return counts_from_items(parsed_items(replies))


def take_first_per_batch(records: DataFrame, accounting: DataFrame) -> DataFrame:
    """The first ``accepted`` records of each reply, in reply order."""
    acc = accounting.select("batch", "accepted")
    return join_checked(records, acc, "batch").where(F.col("pos") < F.col("accepted")).drop("accepted")


def assemble_synthetic(records: DataFrame, profile: DataFrame, features: Sequence[str], n: int,
                       seed: int = 42, label_col: str | None = None, label: str = "ssh") -> DataFrame:
    """Required-feature check, drop incomplete, clip to the profile
    bounds, cap at ``n`` rows; optionally add the label column."""
    out = require_features(records, features)
    out = drop_incomplete(out, features)
    out = clip_to_profile(out, profile, features)
    out = cap_rows(out, n, seed, key_cols=list(features))
    if label_col:
        out = out.withColumn(label_col, F.lit(label))
    return out


def gaussian_baseline(spark: SparkSession, profile: DataFrame, features: Sequence[str], n: int, seed: int,
                      noise_scale: float) -> DataFrame:
    """Per feature Normal(mean + bias, std * noise), bias ~ U(-1, 1) per
    feature, clipped to the profile's [min, max]. Draws are counter-based
    (md5 of ``seed:feature:row``), so the table is the same on any
    partitioning. Output ``(id, features...)``; rows are generated by
    ``spark.range`` in parallel against the broadcast one-row profile."""
    wide = profile.where(F.col("feature").isin(list(features))).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{i}")
          for i, f in enumerate(features) for c in ("mean", "std", "min_v", "max_v")])
    rows = spark.range(int(n)).crossJoin(F.broadcast(wide))
    cols = []
    for i, f in enumerate(features):
        bias = F.lit(2.0) * md5_unit(F.lit(f"{seed}:{f}:bias")) - F.lit(1.0)
        z = md5_normal(F.concat(F.lit(f"{seed}:{f}:"), F.col("id").cast("string")))
        v = F.col(f"_mean_{i}") + bias + F.col(f"_std_{i}") * F.lit(float(noise_scale)) * z
        cols.append(F.least(F.greatest(v, F.col(f"_min_v_{i}")), F.col(f"_max_v_{i}")).alias(f))
    return rows.select("id", *cols)


def record_audit(records: DataFrame, profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per batch, records breaking the output rules: a feature missing,
    a non-positive value, a value outside the profile's [min, max], and
    records whose feature vector occurs more than once in the whole output.
    Duplicates are counted by aggregating first (per vector and batch), so a
    vector repeated a million times is one row before any join."""
    bounds = profile.where(F.col("feature").isin(list(features))).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{i}")
          for i, f in enumerate(features) for c in ("min_v", "max_v")])
    r = records.crossJoin(F.broadcast(bounds))
    any_of = lambda conds: F.coalesce(greatest_of(F.when(c, 1).otherwise(0) for c in conds), F.lit(0)) == 1
    flagged = r.select("batch", *features,
                       any_of([F.col(f).isNull() for f in features]).alias("_missing"),
                       any_of([F.col(f) <= 0 for f in features]).alias("_nonpos"),
                       any_of([(F.col(f) < F.col(f"_min_v_{i}")) | (F.col(f) > F.col(f"_max_v_{i}"))
                               for i, f in enumerate(features)]).alias("_range"))
    per = flagged.groupBy("batch").agg(F.count(F.lit(1)).alias("n_records"),
                                       F.count_if("_missing").alias("n_missing"),
                                       F.count_if("_nonpos").alias("n_nonpositive"),
                                       F.count_if("_range").alias("n_out_of_range"))
    complete = records.where(greatest_of(F.col(f).isNull().cast("int") for f in features) == 0)
    vb = complete.groupBy(*features, "batch").agg(F.count(F.lit(1)).alias("_c"))
    vt = vb.groupBy(*features).agg(F.sum("_c").alias("_t"))
    # repeated vectors are written: the other side is then dealt anew, and Spark can split a vector that every batch holds
    dup = (join_checked(vb, vt.where(F.col("_t") > 1), list(features))
           .groupBy("batch").agg(F.sum("_c").cast("bigint").alias("n_duplicate")))
    return (per.join(dup, "batch", "left").fillna(0, ["n_duplicate"])
            .select("batch", "n_records", "n_missing", "n_nonpositive", "n_out_of_range", "n_duplicate"))
