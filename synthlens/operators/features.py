"""Session features from packet and connection tables.

The generator only defines these features in words; here they are built
from raw tables so the synthetic/real comparison can start from packets.

Hot sessions. A per-session ``lag`` window puts a whole session in one
task; one session may hold a third of all packets, and most of them may
share one second. The packets are therefore range-partitioned by (session,
time, id) into parts of about ``slice_rows`` rows, so a slice (the rows of
one session in one part) is cut by position and ties are cut by id. The
lag is taken inside each slice, and a slice's first packet is linked to the
previous slice's last packet through a small per-slice table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlens.functions.numeric import ratio
from synthlens.operators.joins import join_checked
from synthlens.session import scratch_dir

MICROS = 1_000_000.0
SKETCH_LG_K = 14


def _micros(ts_col: str):
    """Microseconds since the epoch of a TIMESTAMP_NTZ (or TIMESTAMP) column,
    independent of the session time zone for wall-clock (NTZ) input."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts_col}`)")


def _sliced(packets: DataFrame, session_col: str, ts_col: str, id_col: str, slice_rows: int) -> DataFrame:
    """``(_s, _id, _ts, _t, _p)``: every packet with its part number, in the
    order of (session, time, id). Written once, so that the numbers hold."""
    base = packets.select(F.col(session_col).alias("_s"), F.col(id_col).alias("_id"),
                          F.col(ts_col).alias("_ts"), _micros(ts_col).alias("_t"))
    least = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-packets.count() // slice_rows))
    dealt = base.repartitionByRange(parts, F.col("_s"), F.col("_t").asc_nulls_last(), F.col("_id"))
    path = scratch_dir(packets.sparkSession, "packet-slices")
    numbered = dealt.withColumn("_p", F.spark_partition_id())
    numbered.write.parquet(path)
    return packets.sparkSession.read.schema(numbered.schema).parquet(path)


def packet_gaps(packets: DataFrame, session_col: str, ts_col: str, id_col: str, slice_rows: int = 500_000) -> DataFrame:
    """``(_s, _id, _ts, _t, gap)`` for every packet; the gap is NULL for a
    session's first packet, without a time and without a session."""
    sliced = _sliced(packets, session_col, ts_col, id_col, slice_rows)
    w = Window.partitionBy("_s", "_p").orderBy(F.col("_t").asc_nulls_last(), "_id")
    inner = sliced.withColumn("_prev", F.lag("_t").over(w))
    ends = (sliced.where(F.col("_s").isNotNull()).groupBy("_s", "_p").agg(F.max("_t").alias("_last"))
            .withColumn("_link", F.lag("_last").over(Window.partitionBy("_s").orderBy("_p")))
            .where(F.col("_link").isNotNull()).select("_s", "_p", "_link"))
    linked = join_checked(inner, ends, ["_s", "_p"], "left")
    gap = (F.col("_t") - F.coalesce("_prev", "_link")) / F.lit(MICROS)
    return linked.select("_s", "_id", "_ts", "_t", F.when(F.col("_s").isNotNull(), gap).alias("gap"))


def stats_of_gaps(rows: DataFrame, session_col: str) -> DataFrame:
    """K03 and K04 from the rows of ``packet_gaps``."""
    return rows.groupBy(F.col("_s").alias(session_col)).agg(
        F.count(F.lit(1)).alias("n_packets"), F.avg("gap").alias("ipa_mean"), F.var_pop("gap").alias("ipa_var"),
        ((F.max("_t") - F.min("_t")) / F.lit(MICROS)).alias("duration"))


def ipa_gaps(packets: DataFrame, session_col: str, ts_col: str, id_col: str,
             slice_rows: int = 500_000) -> DataFrame:
    """Gap (seconds) from each packet to the previous packet of its
    session, in ``(ts, id)`` order. The first packet of a session has no
    gap and is not returned, nor is a packet without a time or a session.
    Output ``(session, id, ts, gap)``."""
    return (packet_gaps(packets, session_col, ts_col, id_col, slice_rows).where(F.col("gap").isNotNull())
            .select(F.col("_s").alias(session_col), F.col("_id").alias(id_col), F.col("_ts").alias(ts_col), "gap"))


def session_stats(packets: DataFrame, session_col: str, ts_col: str, id_col: str,
                  slice_rows: int = 500_000) -> DataFrame:
    """K03 and K04 from one aggregate: ``(session, n_packets, ipa_mean,
    ipa_var, duration)``; mean and population variance are over the N-1
    gaps, the duration is last - first in seconds."""
    return stats_of_gaps(packet_gaps(packets, session_col, ts_col, id_col, slice_rows), session_col)


def ipa_stats(packets: DataFrame, session_col: str, ts_col: str, id_col: str) -> DataFrame:
    """Per session, packets, mean and population variance of the N-1
    gaps (N-1 gaps divided by N-1). Output ``(session, n_packets, ipa_mean,
    ipa_var)``."""
    return session_stats(packets, session_col, ts_col, id_col).drop("duration")


def session_time(packets: DataFrame, session_col: str, ts_col: str, id_col: str) -> DataFrame:
    """Duration (last - first, seconds) and its residual against
    ``(N-1) x mean gap``; a null session has none."""
    st = session_stats(packets, session_col, ts_col, id_col).where(F.col(session_col).isNotNull())
    return st.select(session_col, "n_packets", "duration", "ipa_mean",
                     F.abs(F.col("duration") - (F.col("n_packets") - 1) * F.col("ipa_mean")).alias("residual"))


def connection_stats(conns: DataFrame, dst_col: str, src_col: str) -> DataFrame:
    """Per destination, connections, distinct sources, and connections
    per source. Spark plans the distinct count as a (dst, src) aggregate
    first, so a hot destination is spread over its sources."""
    out = conns.groupBy(dst_col).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(src_col).alias("n_sources"))
    return out.withColumn("avg_per_source", ratio(F.col("total"), F.col("n_sources")))


def connection_sketches(conns: DataFrame, dst_col: str, src_col: str, period: Column, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """K01 in a form that is kept and added to: ``(destination, period, total,
    sources)``, where ``sources`` is a sketch of the distinct sources (about
    2^lg_k bytes at most, whatever their number). A period is sketched when
    it is complete and never read again. A NULL source is no source, as in
    the exact count; a NULL destination or period is a group of its own."""
    return conns.groupBy(dst_col, period.alias("period")).agg(
        F.count(F.lit(1)).alias("total"), F.hll_sketch_agg(F.col(src_col), F.lit(lg_k)).alias("sources"))


def stats_from_sketches(sketches: DataFrame, dst_col: str) -> DataFrame:
    """K01 over any set of periods, from their sketches alone: ``(destination,
    total, n_sources, avg_per_source)``. ``n_sources`` is an estimate with a
    relative standard error of about 1.04 / sqrt(2^lg_k), 0.8 % by default; a
    source in several periods counts once."""
    out = sketches.groupBy(dst_col).agg(F.sum("total").alias("total"),
                                        F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("n_sources"))
    return out.withColumn("avg_per_source", ratio(F.col("total"), F.col("n_sources")))


def transfer_stats(packets: DataFrame, session_col: str, ts_col: str, bytes_col: str, sent) -> DataFrame:
    """Per session bytes sent and received, their ratio, duration and
    transmit speed (bytes sent / duration; NULL for a zero duration or zero
    received bytes)."""
    b = F.col(bytes_col).cast("double")
    out = packets.groupBy(session_col).agg(
        F.sum(F.when(sent, b).otherwise(F.lit(0.0))).alias("bytes_sent"),
        F.sum(F.when(sent, F.lit(0.0)).otherwise(b)).alias("bytes_recv"),
        ((F.max(_micros(ts_col)) - F.min(_micros(ts_col))) / F.lit(MICROS)).alias("duration"))
    return out.withColumns({"ratio": ratio(F.col("bytes_sent"), F.col("bytes_recv")),
                            "speed": ratio(F.col("bytes_sent"), F.col("duration"))})


def log_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``100 * (ln(1+x) - lo) / (hi - lo)`` with lo/hi the min/max of
    ``ln(1+x)`` over the table (one broadcast aggregate row); a constant
    column divides by 1."""
    logs = {c: F.ln(F.lit(1.0) + F.col(c).cast("double")) for c in cols}
    rng = df.agg(*[F.min(v).alias(f"_lo_{i}") for i, v in enumerate(logs.values())],
                 *[F.max(v).alias(f"_hi_{i}") for i, v in enumerate(logs.values())])
    out = df.crossJoin(F.broadcast(rng))
    scaled = {}
    for i, c in enumerate(cols):
        lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        scaled[c] = F.lit(100.0) * (logs[c] - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    out = out.withColumns(scaled)
    return out.drop(*[f"_lo_{i}" for i in range(len(cols))], *[f"_hi_{i}" for i in range(len(cols))])


def session_type(df: DataFrame, ratio_col: str = "ratio", out: str = "session_type") -> DataFrame:
    """Upload above 1.0, interactive in [0.3, 0.7], remote execution in
    [0.1, 0.3), else other."""
    r = F.col(ratio_col)
    return df.withColumn(out, F.when(r > 1.0, "bulk_upload").when((r >= 0.3) & (r <= 0.7), "interactive")
                         .when((r >= 0.1) & (r < 0.3), "remote_exec").otherwise("other"))


def _rel_violation(actual, expected, tol):
    scale = F.greatest(F.abs(actual), F.abs(expected), F.lit(1e-12))
    return F.abs(actual - expected) / scale > F.lit(tol)


def coherence_audit(conn_stats: DataFrame | None, sessions: DataFrame | None, tol: float = 1e-6,
                    gaps: DataFrame | None = None, session_col: str = "session") -> DataFrame:
    """Relative residuals above ``tol``, counted, of the stated values:
    R1 (average per source = total / sources), R2 (speed = bytes sent /
    duration), R3 (ratio = bytes sent / bytes received), R6 (duration =
    (N-1) x mean gap) and, where the ``gaps`` of ``packet_gaps`` are given,
    R4 (mean = sum of the N-1 gaps / (N-1)) and R5 (variance = mean square
    of the gaps around the stated mean). Output ``(rule, checked,
    violations)``."""
    parts = []

    def audit(rule: str, df: DataFrame, actual: str, expected: Column) -> None:
        parts.append(df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("checked"),
                            F.count_if(_rel_violation(F.col(actual), expected, tol)).alias("violations")))

    if conn_stats is not None:
        audit("R1", conn_stats.where(F.col("n_sources") > 0), "avg_per_source", F.col("total") / F.col("n_sources"))
    if sessions is not None:
        audit("R2", sessions.where(F.col("duration") > 0), "speed", F.col("bytes_sent") / F.col("duration"))
        audit("R3", sessions.where(F.col("bytes_recv") > 0), "ratio", F.col("bytes_sent") / F.col("bytes_recv"))
        if gaps is not None:
            stated = sessions.select(F.col(session_col).alias("_s"), "ipa_mean", "ipa_var", "n_packets")
            own = (join_checked(gaps.where(F.col("gap").isNotNull()).select("_s", "gap"), stated, "_s")
                   .groupBy("_s", "ipa_mean", "ipa_var", "n_packets")
                   .agg(F.sum("gap").alias("_sum"), F.sum((F.col("gap") - F.col("ipa_mean")) ** 2).alias("_square"))
                   .where((F.col("n_packets") > 1) & F.col("ipa_mean").isNotNull()))
            audit("R4", own, "ipa_mean", F.col("_sum") / (F.col("n_packets") - 1))
            audit("R5", own, "ipa_var", F.col("_square") / (F.col("n_packets") - 1))
        audit("R6", sessions.where(F.col("ipa_mean").isNotNull()), "duration",
              (F.col("n_packets") - 1) * F.col("ipa_mean"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
