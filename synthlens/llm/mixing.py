"""Mixing sources to target weights with exact token budgets.

Each source gets a share of the whole size by its weight; a share stops at
``max_epochs`` times its source's size and the excess is reshared by weight
among the others until none is above (a water level over the sources). A
document's key is md5(seed:id), uniform by construction, so its leading hex
digits cut every source into equal key ranges: range sums give each range's
start, a running sum inside the range gives each document's position, and
the budget's cut is one comparison per document. Whole epochs repeat every
document; the last, partial epoch takes the documents before the cut (the
document at the cut is taken if that brings the total nearer to the target).

A hot source is spread over 4096 key ranges; no task sees a whole source.
Cases: null text has size 0; null source is a source of its own, last in
order; null ids share the key of the text ``null``; an empty table gives an
empty result; repeated rows are placed one after another. Columns named in
``carry`` travel in a struct, so their names cannot clash with the results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthlens.llm.common import hex_key, n_words_col

RANGE_DIGITS = 3  # 16^3 key ranges per source


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int, share: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per
    source. Sources in code point order, null last, take the weights in
    turn. The table has one row per source, far below one task's size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", w.cast("bigint")).withColumn("_cap", F.col("source_size") * max_epochs)
    # sources in the order in which a rising water level reaches their caps
    level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("_rest", F.sum("source_size").over(everything).cast("double") * F.lit(share)
                      - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
         .withColumn("_wsum", F.sum("_w").over(after)))
    open_ = F.col("_rest") * F.col("_w") <= F.col("_cap").cast("double") * F.col("_wsum")
    first = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_w"), F.col("_rest"), F.col("_wsum"))))
    s = s.withColumn("_level", first.over(everything))
    fair = F.col("_level")["_rest"] * F.col("_w") / F.col("_level")["_wsum"]
    cap = F.col("_cap").cast("double")
    return s.select("source", "source_size", F.least(cap, F.coalesce(fair, cap)).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0,
                seed: int = 6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target,
    copies, taken[, row]); ``row`` is a struct of the ``carry`` columns."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       n_words_col(F.col(text_col)).alias("size"),
                       *([F.struct(*carry).alias("row")] if carry else []))
    key = hex_key(F.lit(seed), F.col("doc_id"))
    base = base.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    ranges = base.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs,
                             share)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = (starts.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
              .select(F.col("a.source").alias("_source"), F.col("_range").alias("_r"), "_start", "source_size",
                      "target"))
    inside = (Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = base.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")),
                                                     F.lit(max_epochs))).otherwise(0).cast("bigint")
    placed = placed.withColumn("_whole", whole)
    left = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = (2 * (F.col("_start") + F.col("_inside")) + F.col("size") < 2 * left) & (F.col("_whole") < max_epochs)
    copies = F.col("_whole") + extra.cast("bigint")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))
