"""Exact-size, reproducible samples.

``DataFrame.sample`` is Bernoulli (size varies) and ``rand`` depends on the
partitioning. Here every row gets a key ``md5(seed : row text : copy)``,
where ``copy`` numbers the rows that carry the same text, and the sample is
the ``n`` rows with the smallest keys. Copies have keys of their own, so a
repeated row is drawn as often as its share of the table. The row set is the
same on any layout and any engine.

The input is read once: equal rows are counted and the counts written. One
rule for every ``n``: keys are counted there by their leading hex digits (4096
counts per pass), the range that holds the n-th key is narrowed until it is
small, and only that range is ordered; copies are laid out only to draw their
keys, and those above the range end there. No task holds ``n`` rows, all
copies of a frequent row, or all rows of a frequent name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlens.operators.joins import join_keys, written

DIGITS = 3  # hex digits per counting pass
RANGE_ROWS = 50_000  # a range this small is ordered
COPY_CHUNK = 10_000  # copies of one row that one task numbers at a time
NAME_ROWS = 100_000  # different rows of one name that one task numbers


def sample_key(seed: int, cols: Sequence[str], copy: Column) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts, copy.cast("string")))


def row_counts(df: DataFrame, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Written table: each distinct row, how often it occurs (``_c``), and how
    many rows of its name lie before it (``_before``). A name with more than
    ``NAME_ROWS`` different rows is cut into ranges of its rows: sums of the
    ranges before, then a running sum within the range."""
    cols = df.columns
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    if not key_cols or set(key_cols) == set(cols):
        return written(counts.withColumn("_before", F.lit(0).cast("bigint")), "sample-counts")
    keys = list(key_cols)
    counts = written(counts, "sample-rows")
    frequent = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > NAME_ROWS).select(*keys)
    frequent = written(frequent, "sample-names")

    def running(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))

    if not frequent.take(1):
        return written(running(counts, *keys), "sample-counts")
    usual = running(join_keys(counts, frequent, keys, "left_anti"), *keys)
    ranges = (join_keys(counts, frequent, keys, "left_semi")
              .repartitionByRange(*keys, *[c for c in cols if c not in keys]).withColumn("_part", F.spark_partition_id()))
    ranges = written(ranges, "sample-ranges")
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a name
    sums = ranges.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    hot = join_keys(running(ranges, *keys, "_part"), sums, [*keys, "_part"])
    hot = hot.withColumn("_before", F.col("_before") + F.col("_base"))
    return written(usual.unionByName(hot.select(*usual.columns)), "sample-counts")


def laid_out(counts: DataFrame, cols: Sequence[str], out: str = "_copy") -> DataFrame:
    """Every copy of the counted rows with its number among the rows of its
    name, from 1. Only rows with more than ``COPY_CHUNK`` copies are dealt to
    several tasks."""
    step = F.lit(COPY_CHUNK)
    first = F.col("_k") * step + 1
    number = F.explode(F.sequence(first, F.least(F.col("_c"), first + step - 1)))
    few = counts.where(F.col("_c") <= step).withColumn("_k", F.lit(0).cast("bigint"))
    many = counts.where(F.col("_c") > step).withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / step))))
    dealt = few.unionByName(many.repartition(*cols, "_k"))
    return dealt.select(*cols, "_before", number.alias("_i")).select(*cols, (F.col("_before") + F.col("_i")).alias(out))


def exact_sample(df: DataFrame, n: int, seed: int = 42, key_cols: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows without replacement, or every row if there are not
    more than ``n``. ``key_cols``: columns that name a row (default: all)."""
    n = int(n)
    cols = list(key_cols) if key_cols else list(df.columns)
    if n <= 0:
        return df.limit(0)
    counts = row_counts(df, cols)
    keyed = laid_out(counts, df.columns)
    if (counts.agg(F.sum("_c")).first()[0] or 0) <= n:
        return keyed.select(*df.columns)
    keyed = keyed.withColumn("_key", sample_key(seed, cols, F.col("_copy")))
    prefix, need = "", n
    while True:
        digits = len(prefix) + DIGITS
        here = keyed.where(F.col("_key").startswith(prefix)) if prefix else keyed
        found = (here.groupBy(F.substring("_key", 1, digits).alias("p")).count().orderBy("p")
                 .collect())  # at most 16^DIGITS rows
        for r in found:
            if need <= r["count"]:
                prefix, size = r["p"], r["count"]
                break
            need -= r["count"]
        if size <= RANGE_ROWS or digits >= 30:
            break
    below = keyed.where(F.substring("_key", 1, len(prefix)) < prefix)
    last = keyed.where(F.col("_key").startswith(prefix)).orderBy("_key", *cols, "_copy").limit(need)
    return below.unionByName(last).select(*df.columns)


def sample_sentinel(df: DataFrame, n: int, seed: int = 42, key_cols: Sequence[str] | None = None) -> DataFrame:
    """-1 = all rows, 0 = no rows, n > 0 = at most n (exact sample)."""
    return df if n < 0 else exact_sample(df, n, seed, key_cols)


def cap_rows(df: DataFrame, n: int, seed: int = 42, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Keep every row if there are at most ``n``, else an exact sample of ``n``."""
    return exact_sample(df, n, seed, key_cols)
