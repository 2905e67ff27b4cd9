"""Distribution fidelity: histograms, Jensen-Shannon divergence, box
statistics, hexagonal density, standardisation and a 2-D embedding
(A07-A09, A14-A15, J04, M02-M03, U02).

Scale notes. Binning happens in the wide row (one expression per feature
against a broadcast one-row range table), then the bin numbers unpivot and
count in one hash aggregate: the shuffle carries at most
``groups x features x bins`` keys per task. Everything after the counts
works on ``features x bins`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlens.functions.numeric import bin_edge, hist_bin, round_binary
from synthlens.operators.joins import join_keys, written
from synthlens.operators.profile import exact_quantiles, unpivot_long

EPS = 1e-10


def labelled_union(parts: Sequence[tuple[str, DataFrame]], features: Sequence[str],
                   group_col: str = "grp") -> DataFrame:
    """Union by name with a group label column."""
    out = None
    for name, d in parts:
        d = d.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn(group_col, F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def _wide_ranges(ranges: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row ``_lo_i, _hi_i`` per feature; a constant range gets a NULL
    upper bound, so its bin is NULL through plain null propagation (a
    per-row CASE around the bin rule would block common-subexpression
    elimination and cost 4-5x)."""
    live = F.col("hi") > F.col("lo")
    return ranges.agg(*[F.max(F.when(F.col("feature") == f, F.col("lo"))).alias(f"_lo_{i}") for i, f in enumerate(features)],
                      *[F.max(F.when((F.col("feature") == f) & live, F.col("hi"))).alias(f"_hi_{i}")
                        for i, f in enumerate(features)])


def pair_by_group(df: DataFrame, group_col: str, p_value, q_value, features: Sequence[str]) -> DataFrame:
    """Both sides from one table: rows of group ``p_value`` become ``p``,
    of ``q_value`` become ``q`` (one scan per pass instead of two)."""
    g = F.col(group_col)
    return (df.where(g.isin(p_value, q_value))
            .select(F.when(g == p_value, F.lit("p")).otherwise(F.lit("q")).alias("grp"),
                    *[F.col(f).cast("double").alias(f) for f in features]))


def pair_of(p_df: DataFrame, q_df: DataFrame, features: Sequence[str]) -> DataFrame:
    return labelled_union([("p", p_df), ("q", q_df)], features)


def pair_ranges(pair: DataFrame, features: Sequence[str]) -> DataFrame:
    """A05 on a labelled pair: one aggregate, one row per feature
    ``(pos, feature, lo, hi)``."""
    row = pair.agg(*[F.min(f).alias(f"lo_{i}") for i, f in enumerate(features)],
                   *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(features)])
    stacked = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"lo_{i}").alias("lo"),
                        F.col(f"hi_{i}").alias("hi")) for i, f in enumerate(features)]
    return row.select(F.explode(F.array(*stacked)).alias("s")).select("s.*")


def pair_histogram(pair: DataFrame, features: Sequence[str], bins: int = 30,
                   ranges: DataFrame | None = None) -> DataFrame:
    """A07 core on a labelled pair (``grp`` in p/q)."""
    ranges = ranges if ranges is not None else pair_ranges(pair, features)
    rw = F.broadcast(_wide_ranges(ranges, features))
    binned = pair.crossJoin(rw).select(
        "grp", *[hist_bin(F.col(f), F.col(f"_lo_{i}"), F.col(f"_hi_{i}"), bins).alias(f) for i, f in enumerate(features)])
    return (binned.unpivot(["grp"], list(features), "feature", "bin").where(F.col("bin").isNotNull())
            .groupBy("feature", "grp", "bin").agg(F.count(F.lit(1)).alias("n")))


def pair_align(pair: DataFrame, features: Sequence[str], bins: int = 30,
               ranges: DataFrame | None = None) -> DataFrame:
    """J04 core: scaffold ``features x bins`` left-joined to both counts."""
    all_ranges = ranges if ranges is not None else pair_ranges(pair, features)
    live = all_ranges.where(F.col("hi") > F.col("lo"))
    counts = pair_histogram(pair, features, bins, all_ranges)
    cw = counts.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("grp") == "p", F.col("n")).otherwise(0)).alias("n_p"),
        F.sum(F.when(F.col("grp") == "q", F.col("n")).otherwise(0)).alias("n_q"))
    k = F.col("bin")
    scaffold = live.crossJoin(F.broadcast(pair.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))
    scaffold = scaffold.select("feature", "bin", bin_edge(k, F.col("lo"), F.col("hi"), bins).alias("lo_edge"),
                               bin_edge(k + 1, F.col("lo"), F.col("hi"), bins).alias("hi_edge"))
    return (scaffold.join(cw, ["feature", "bin"], "left")
            .select("feature", "bin", "lo_edge", "hi_edge",
                    F.coalesce("n_p", F.lit(0)).cast("bigint").alias("n_p"),
                    F.coalesce("n_q", F.lit(0)).cast("bigint").alias("n_q")))


def _divergence(aligned: DataFrame, by: Sequence[str], eps: float) -> DataFrame:
    """``(by..., v)`` of bin counts ``(by..., lo_edge, hi_edge, n_p, n_q)``."""
    w = Window.partitionBy(*by)
    width = F.col("hi_edge") - F.col("lo_edge")
    d = aligned.withColumns({
        "dp": F.col("n_p") / width / F.sum("n_p").over(w) + F.lit(eps),
        "dq": F.col("n_q") / width / F.sum("n_q").over(w) + F.lit(eps),
    })
    d = d.withColumns({"ph": F.col("dp") / F.sum("dp").over(w), "qh": F.col("dq") / F.sum("dq").over(w)})
    d = d.withColumn("m", F.lit(0.5) * (F.col("ph") + F.col("qh")))
    return d.groupBy(*by).agg(
        (F.lit(0.5) * (F.sum(F.col("ph") * F.ln(F.col("ph") / F.col("m")))
                       + F.sum(F.col("qh") * F.ln(F.col("qh") / F.col("m"))))).alias("v"))


def pair_jsd(pair: DataFrame, features: Sequence[str], bins: int = 30, eps: float = EPS,
             places: int = 5) -> DataFrame:
    """A08 core on a labelled pair."""
    ranges = pair_ranges(pair, features)
    per = _divergence(pair_align(pair, features, bins, ranges), ["feature"], eps)
    return (ranges.join(per, "feature", "left")
            .select("pos", "feature", F.when(F.col("hi") > F.col("lo"), round_binary(F.col("v"), places))
                    .otherwise(F.lit(0.0)).alias("jsd"))
            .orderBy("pos").drop("pos"))


def pairs_histogram(rows: DataFrame, pairs: Sequence[tuple[str, Column, Column]], features: Sequence[str],
                    bins: int = 30) -> DataFrame:
    """A05/A07 of several pairs of groups of one table: ``(pair, pos,
    feature, lo, hi, bin, n_p, n_q)``, one row per bin (empty ones too), or
    one row without a bin for a constant range. ``pairs``: (name, condition
    of side p, condition of side q). A row of two pairs feeds both, each with
    its own range: one aggregate finds all ranges, one Expand over pairs and
    features counts all bins, whatever the number of pairs."""
    k = range(len(pairs))
    sided = rows.select(*[F.when(p, F.lit("p")).when(q, F.lit("q")).alias(f"_s{i}") for i, (_, p, q) in enumerate(pairs)],
                        *[F.col(f).cast("double").alias(f) for f in features])
    # columns of their own: a CASE inside the bin rule would be evaluated for each of its uses
    values = {(i, j): F.col(f"_v_{i}_{j}") for i in k for j in range(len(features))}
    sided = sided.select(*[f"_s{i}" for i in k], *[F.when(F.col(f"_s{i}").isNotNull(), F.col(features[j])).alias(f"_v_{i}_{j}")
                                                   for i, j in values])
    row = sided.agg(*[F.min(v).alias(f"_lo_{i}_{j}") for (i, j), v in values.items()],
                    *[F.max(v).alias(f"_hi_{i}_{j}") for (i, j), v in values.items()])
    row = written(row, "pair-ranges")  # one row, read by the bins and by the scaffold
    live = row.select(*[F.col(f"_lo_{i}_{j}") for i, j in values],
                      *[F.when(F.col(f"_hi_{i}_{j}") > F.col(f"_lo_{i}_{j}"), F.col(f"_hi_{i}_{j}")).alias(f"_hi_{i}_{j}")
                        for i, j in values])
    binned = sided.crossJoin(F.broadcast(live)).select(
        *[f"_s{i}" for i in k],
        *[hist_bin(v, F.col(f"_lo_{i}_{j}"), F.col(f"_hi_{i}_{j}"), bins).alias(f"{i}|{j}") for (i, j), v in values.items()])
    counts = (binned.unpivot([f"_s{i}" for i in k], [f"{i}|{j}" for i, j in values], "key", "bin")
              .where(F.col("bin").isNotNull())
              .withColumn("side", F.array(*[f"_s{i}" for i in k])[F.substring_index("key", "|", 1).cast("int")])
              .groupBy("key", "bin").agg(F.count_if(F.col("side") == "p").alias("n_p"),
                                         F.count_if(F.col("side") == "q").alias("n_q")))
    stacked = [F.struct(F.lit(f"{i}|{j}").alias("key"), F.lit(pairs[i][0]).alias("pair"), F.lit(j).alias("pos"),
                        F.lit(features[j]).alias("feature"), F.col(f"_lo_{i}_{j}").alias("lo"),
                        F.col(f"_hi_{i}_{j}").alias("hi")) for i, j in values]
    ranges = row.select(F.inline(F.array(*stacked)))
    steps = F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(None).cast("int")))
    scaffold = ranges.withColumn("bin", F.explode(steps))
    return (scaffold.join(counts, ["key", "bin"], "left").drop("key")
            .select("pair", "pos", "feature", "lo", "hi", "bin", F.coalesce("n_p", F.lit(0)).cast("bigint").alias("n_p"),
                    F.coalesce("n_q", F.lit(0)).cast("bigint").alias("n_q")))


def pairs_jsd(rows: DataFrame, pairs: Sequence[tuple[str, Column, Column]], features: Sequence[str], bins: int = 30,
              eps: float = EPS, places: int = 5) -> DataFrame:
    """A08 of several pairs of groups of one table: ``(feature, <pair>...)``,
    one column per pair, features in the given order. The table is read
    twice in all: for the ranges and for the bins."""
    b = F.col("bin")
    hist = written(pairs_histogram(rows, pairs, features, bins), "pair-bins")  # a row per pair, feature and bin, read twice
    aligned = hist.where(b.isNotNull()).withColumns({"lo_edge": bin_edge(b, F.col("lo"), F.col("hi"), bins),
                                                     "hi_edge": bin_edge(b + 1, F.col("lo"), F.col("hi"), bins)})
    per = _divergence(aligned, ["pair", "pos", "feature"], eps).select(
        "pair", "pos", "feature", round_binary(F.col("v"), places).alias("jsd"))
    flat = hist.where(b.isNull()).select("pair", "pos", "feature", F.lit(0.0).alias("jsd"))
    return (per.unionByName(flat).groupBy("pos", "feature")
            .agg(*[F.max(F.when(F.col("pair") == name, F.col("jsd"))).alias(name) for name, _, _ in pairs])
            .orderBy("pos").drop("pos"))


def feature_histogram(p_df: DataFrame, q_df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """Fixed-width counts over the joint range of the pair, last bin
    closed. Output ``(feature, grp, bin, n)`` for non-empty bins; ``grp`` is
    ``p`` or ``q``. A feature with a constant joint range has no bins."""
    return pair_histogram(pair_of(p_df, q_df, features), features, bins)


def histogram_align(p_df: DataFrame, q_df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """Both histograms bin by bin, empty bins kept. Output ``(feature,
    bin, lo_edge, hi_edge, n_p, n_q)``."""
    return pair_align(pair_of(p_df, q_df, features), features, bins)


def jsd(p_df: DataFrame, q_df: DataFrame, features: Sequence[str], bins: int = 30,
        eps: float = EPS, places: int = 5) -> DataFrame:
    """Jensen-Shannon divergence per feature (natural log).

    Histogram densities (count / width / total) over the joint range, plus
    ``eps`` per bin, renormalised; ``0.5 * (KL(p||m) + KL(q||m))`` rounded to
    ``places``. A constant joint range gives 0.0. Output ``(feature, jsd)``.
    For two groups of one table use ``pair_jsd(pair_by_group(...))``.
    """
    return pair_jsd(pair_of(p_df, q_df, features), features, bins, eps, places)


def jsd_summary(jsd_a: DataFrame, jsd_b: DataFrame, name_a: str = "A", name_b: str = "B",
                average_label: str = "__mean__") -> DataFrame:
    """Per feature both divergences and the winner (strictly lower,
    else ``tie``); one more row with the mean of the rounded values, where a
    tie goes to the second input."""
    return compare_jsd(jsd_a.withColumnRenamed("jsd", "jsd_a").join(jsd_b.withColumnRenamed("jsd", "jsd_b"), "feature"),
                       name_a, name_b, average_label)


def compare_jsd(both: DataFrame, name_a: str = "A", name_b: str = "B", average_label: str = "__mean__") -> DataFrame:
    """A09 of ``(feature, jsd_a, jsd_b)``, as ``pairs_jsd`` gives it."""
    per = both.withColumn("winner", F.when(F.col("jsd_a") < F.col("jsd_b"), F.lit(name_a))
                          .when(F.col("jsd_b") < F.col("jsd_a"), F.lit(name_b)).otherwise(F.lit("tie")))
    avg = both.agg(F.avg("jsd_a").alias("jsd_a"), F.avg("jsd_b").alias("jsd_b")).select(
        F.lit(average_label).alias("feature"), "jsd_a", "jsd_b",
        F.when(F.col("jsd_a") < F.col("jsd_b"), F.lit(name_a)).otherwise(F.lit(name_b)).alias("winner"))
    return per.unionByName(avg)


def box_stats(df: DataFrame, features: Sequence[str], group_col: str, whis: float = 1.5) -> DataFrame:
    """Quartiles and whiskers per (group, feature), outliers hidden.

    Whiskers are the most extreme values inside ``[Q1 - whis*IQR,
    Q3 + whis*IQR]``, never inside the box. Quartiles by the distributed
    exact selection; the whiskers are one conditional min/max aggregate
    against the quartile table (groups x features rows; broadcast if they are
    few, see ``join_keys``).
    """
    long_df = unpivot_long(df, features, [group_col])
    keys = [group_col, "feature"]
    qs = exact_quantiles(long_df, keys, [0.25, 0.5, 0.75])
    qw = qs.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n)
                                 for p, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))])
    qw = qw.withColumns({"_lo": F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1")),
                         "_hi": F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))})
    x = F.col("x")
    wh = (join_keys(long_df, qw, keys)
          .groupBy(*keys, "q1", "med", "q3")
          .agg(F.min(F.when(x >= F.col("_lo"), x)).alias("_wlo"), F.max(F.when(x <= F.col("_hi"), x)).alias("_whi"),
               F.count(F.lit(1)).alias("n")))
    return wh.select(*keys, "n", "q1", "med", "q3",
                     F.least(F.col("q1"), F.coalesce("_wlo", "q1")).alias("whislo"),
                     F.greatest(F.col("q3"), F.coalesce("_whi", "q3")).alias("whishi"))


def hexbin_density(df: DataFrame, x_col: str, y_col: str, group_col: str, gridsize: int = 35) -> DataFrame:
    """Hexagonal binning per group over each group's own extent.

    Two offset lattices; a point goes to the nearer centre (lattice 1 on a
    strict win). ``ny = int(nx / sqrt(3))``, the x extent padded by 1e-9 of
    its width, a degenerate extent widened by 10%; a NULL group is a group. Output ``(grp, lattice,
    i, j, n)`` for cells with at least one point.
    """
    nx = gridsize
    ny = int(nx / np.sqrt(3.0))
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    ext = df.groupBy(group_col).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"),
                                    F.min(y).alias("_y0"), F.max(y).alias("_y1"))

    def nonsingular(a, b):
        same = a == b
        zero = same & (a == 0)
        lo = F.when(zero, F.lit(-0.1)).when(same, a - F.lit(0.1) * F.abs(a)).otherwise(a)
        hi = F.when(zero, F.lit(0.1)).when(same, b + F.lit(0.1) * F.abs(b)).otherwise(b)
        return lo, hi

    x0, x1 = nonsingular(F.col("_x0"), F.col("_x1"))
    y0, y1 = nonsingular(F.col("_y0"), F.col("_y1"))
    pad = F.lit(1e-9) * (x1 - x0)
    ext = ext.select(group_col, (x0 - pad).alias("xmin"), (x1 + pad).alias("xmax"), y0.alias("ymin"), y1.alias("ymax"))
    ext = ext.withColumns({"sx": (F.col("xmax") - F.col("xmin")) / F.lit(float(nx)),
                           "sy": (F.col("ymax") - F.col("ymin")) / F.lit(float(ny))})
    pts = df.select(group_col, x.alias("_x"), y.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    pts = join_keys(pts, ext, [group_col])
    ix = (F.col("_x") - F.col("xmin")) / F.col("sx")
    iy = (F.col("_y") - F.col("ymin")) / F.col("sy")
    pts = pts.select(group_col, ix.alias("ix"), iy.alias("iy"))
    ix1, iy1 = F.rint("ix"), F.rint("iy")
    ix2, iy2 = F.floor("ix").cast("double"), F.floor("iy").cast("double")
    def sq(c):
        return c * c
    d1 = sq(F.col("ix") - ix1) + F.lit(3.0) * sq(F.col("iy") - iy1)
    d2 = sq(F.col("ix") - ix2 - F.lit(0.5)) + F.lit(3.0) * sq(F.col("iy") - iy2 - F.lit(0.5))
    first = d1 < d2
    cells = pts.select(group_col, F.when(first, 1).otherwise(2).alias("lattice"),
                       F.when(first, ix1).otherwise(ix2).cast("int").alias("i"),
                       F.when(first, iy1).otherwise(iy2).cast("int").alias("j"))
    return cells.groupBy(group_col, "lattice", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean 0 and population std 1 per feature over the whole input; a
    zero std gives 0. Statistics are one aggregate row, broadcast."""
    st = df.agg(*[F.avg(f).alias(f"_m_{i}") for i, f in enumerate(features)],
                *[F.stddev_pop(f).alias(f"_s_{i}") for i, f in enumerate(features)])
    out = df.crossJoin(F.broadcast(st))
    out = out.withColumns({f: F.when(F.col(f"_s_{i}") > 0, (F.col(f) - F.col(f"_m_{i}")) / F.col(f"_s_{i}"))
                           .otherwise(F.lit(0.0)) for i, f in enumerate(features)})
    return out.drop(*[f"_m_{i}" for i in range(len(features))], *[f"_s_{i}" for i in range(len(features))])


def embedding_2d(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The first two principal axes of the standardised input.

    One aggregate gives means, population stds and the sample covariance of
    the raw features; the covariance of the standardised features is
    ``cov_ij / (s_i s_j)`` (a zero std gives a zero row/column), so the
    k x k eigen-solve on the driver needs no second pass. The projection of
    the standardised values is then column expressions. Signs fixed: the
    largest-magnitude loading of each axis is positive. Output
    ``(keep..., x, y)``.
    """
    from synthlens.operators.detect import fix_sign

    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                 *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
                 *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    std = np.array([row[f"s{i}"] or 0.0 for i in range(k)])
    cov = np.zeros((k, k))
    for i, j in pairs:
        v = row[f"c{i}_{j}"]
        if v is not None and std[i] > 0 and std[j] > 0:
            cov[i, j] = cov[j, i] = v / (std[i] * std[j])
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:2]
    axes = np.column_stack([fix_sign(vecs[:, a]) for a in order])

    def z(i, f):
        return (F.col(f) - F.lit(float(mean[i]))) / F.lit(float(std[i])) if std[i] > 0 else F.lit(0.0)

    proj = [sum((z(i, f) * F.lit(float(axes[i, a])) for i, f in enumerate(features)), F.lit(0.0)) for a in range(2)]
    return df.select(*keep, proj[0].alias("x"), proj[1].alias("y"))
