"""Profiles and per-feature aggregates.

Feature tables are wide (one column per feature). Per-feature statistics
unpivot once (an Expand, no shuffle) and aggregate every feature in a
single hash aggregate keyed by ``(group, feature)``: at most
``groups x features`` keys, combined map-side before the shuffle.

Exact quantiles. Spark's ``percentile`` keeps a value->count map per key and
merges it in one task per key: one task per feature over the whole table.
``exact_quantiles`` ranks the groups of at most ``max_rows`` values by a
window per group, whatever their number. For larger groups it narrows a
bracket around each wanted rank with bucket counts (map-side combined
aggregates, one pass per level) until the bracket holds at most ``max_rows``
values, then ranks only those. Each level shrinks the bracket by about
``buckets`` times; on 10^12 rows that is three or four passes over the pruned
columns and no task ever holds a whole group. Only the brackets of larger
groups reach the driver: of one in ``max_rows`` values at most. They are sent
to the tasks beside each row (``BRACKETS`` of them at once), so no pass
shuffles the table by its few keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.operators.joins import join_keys, written

BRACKETS = 10_000  # brackets that one pass looks at


def unpivot_long(df: DataFrame, features: Sequence[str], id_cols: Sequence[str] = (),
                 value: str = "x", keep_null: bool = False) -> DataFrame:
    """Wide features to long ``(id_cols..., feature, x)``; NULL values dropped
    unless ``keep_null``."""
    out = (df.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in features])
           .unpivot(list(id_cols), list(features), "feature", value))
    return out if keep_null else out.where(F.col(value).isNotNull())


def _lerp(a: float, b: float, t: float) -> float:
    """Linear interpolation the way numpy's percentile does it."""
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def select_ranks(base: DataFrame, keys: Sequence[str], targets: dict, value: str = "_x",
                 stats: dict | None = None, max_rows: int = 200_000, buckets: int = 2048) -> dict:
    """Exact k-th smallest values, distributed.

    ``targets``: ``{(key tuple, rank): None}`` with 0-based ranks; ``base``
    has the key columns and a non-null numeric ``value`` column. Returns
    ``{(key tuple, rank): value}``. Brackets narrow by bucket counts (one
    aggregate pass per level, collected: at most brackets x buckets rows)
    until a bracket holds at most ``max_rows`` values, which are ranked by a
    window partitioned by bracket (bounded). Passes look at ``BRACKETS``
    brackets at a time. ``stats``: optional
    ``{key tuple: (n, lo, hi)}`` if already known.
    """
    spark = base.sparkSession
    keys = list(keys)
    if stats is None:
        rows = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"),
                                       F.max(value).alias("hi")).collect()
        stats = {tuple(r[c] for c in keys): (r["n"], r["lo"], r["hi"]) for r in rows}
    # state[(k, rank)] = [a, b, below, count]
    state = {t: [stats[t[0]][1], stats[t[0]][2], 0, stats[t[0]][0]] for t in targets}
    key_fields = [base.schema[c] for c in keys]
    vtype = base.schema[value].dataType

    def bracket_df(items):
        rows = [(*k, a, b, i) for i, (k, a, b) in enumerate(items)]
        schema = T.StructType([*key_fields, T.StructField("_a", vtype), T.StructField("_b", vtype),
                               T.StructField("_bid", T.IntegerType())])
        return spark.createDataFrame(rows, schema)

    def in_bracket(br: DataFrame) -> DataFrame:
        br = br.toDF(*[f"_k_{c}" if c in keys else c for c in br.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]  # a NULL group is a group
        joined = base.join(F.broadcast(br), same) if keys else base.crossJoin(F.broadcast(br))  # at most BRACKETS rows
        return joined.where((F.col(value) >= F.col("_a")) & (F.col(value) <= F.col("_b")))

    stuck: set = set()  # brackets that a pass could not split (a range beyond doubles): ranked as they are
    while True:
        pending = sorted({(t[0], st[0], st[1]) for t, st in state.items() if st[3] > max_rows and st[0] < st[1]} - stuck,
                         key=repr)
        if not pending:
            break
        a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
        scaled = F.floor((F.col(value).cast("double") - a) / (b - a) * F.lit(float(buckets)))
        pending = pending[:BRACKETS]
        hist = (in_bracket(bracket_df(pending))
                .withColumn("_bk", F.least(F.lit(buckets - 1), scaled.cast("int")))
                .groupBy("_bid", "_bk").agg(F.count(F.lit(1)).alias("c"), F.min(value).alias("mn"),
                                            F.max(value).alias("mx"))
                .collect())
        per_bid: dict[int, list] = {}
        for h in hist:
            per_bid.setdefault(h["_bid"], []).append((h["_bk"], h["c"], h["mn"], h["mx"]))
        index = {item: i for i, item in enumerate(pending)}
        before_pass = {t: list(st) for t, st in state.items()}
        for t, st in state.items():
            bid = index.get((t[0], st[0], st[1]))
            if bid is None or st[3] <= max_rows or st[0] >= st[1]:
                continue
            below = st[2]
            for _, c, mn, mx in sorted(per_bid.get(bid, [])):
                if t[1] < below + c:
                    state[t] = [mn, mx, below, c]
                    break
                below += c
        stuck |= {(t[0], st[0], st[1]) for t, st in state.items() if (t[0], st[0], st[1]) in index and st == before_pass[t]}

    out = {t: st[0] for t, st in state.items() if st[0] >= st[1]}
    left = sorted({(t[0], st[0], st[1]) for t, st in state.items() if st[0] < st[1]}, key=repr)
    for start in range(0, len(left), BRACKETS):
        final = left[start:start + BRACKETS]
        index = {item: i for i, item in enumerate(final)}
        want_rows = [(index[(t[0], st[0], st[1])], t[1] - st[2], t) for t, st in state.items()
                     if st[0] < st[1] and (t[0], st[0], st[1]) in index]
        want = spark.createDataFrame([(b, r) for b, r, _ in want_rows], "_bid int, _r long")
        w = Window.partitionBy("_bid").orderBy(value)
        ranked = (in_bracket(bracket_df(final)).select("_bid", value)
                  .withColumn("_r", F.row_number().over(w) - 1)
                  .join(F.broadcast(want), ["_bid", "_r"]).collect())
        got = {(r["_bid"], r["_r"]): r[value] for r in ranked}
        for bid, r, t in want_rows:
            out[t] = got[(bid, r)]
    return out


def exact_quantiles(long_df: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "x",
                    max_rows: int = 200_000, buckets: int = 2048, sizes: DataFrame | None = None) -> DataFrame:
    """Linearly interpolated quantiles (numpy/pandas 'linear') per key.

    Returns ``(keys..., prob, q)``; a NULL key is a key. See module doc.
    ``sizes`` (``keys..., n, lo, hi``, a written table) saves the first pass
    when the caller already has it.
    """
    keys = list(keys)
    base = long_df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if sizes is None:
        sizes = written(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"),
                                                F.max("_x").alias("hi")), "quantile-sizes")
    large = sizes.where(F.col("n") > max_rows)  # at most one in max_rows values has such a key
    stats = {tuple(r[c] for c in keys): (r["n"], r["lo"], r["hi"]) for r in large.collect()}
    small = join_keys(base, large.select(*keys), keys, "left_anti") if stats else base
    w = Window.partitionBy(*keys)
    ranked = small.select(*keys, "_x", (F.row_number().over(w.orderBy("_x")) - 1).alias("_r"),
                          F.count(F.lit(1)).over(w).alias("_n"))
    points = []
    for p in probs:
        pos = F.lit(float(p)) * (F.max("_n") - 1)
        at = F.lit(float(p)) * (F.col("_n") - 1)
        a, b = (F.max(F.when(F.col("_r") == f(at), F.col("_x"))) for f in (F.floor, F.ceil))
        t = pos - F.floor(pos)
        q = F.when(t >= 0.5, b - (b - a) * (1.0 - t)).otherwise(a + (b - a) * t)
        points.append(F.struct(F.lit(float(p)).alias("prob"), q.alias("q")))
    out = ranked.groupBy(*keys).agg(F.array(*points).alias("_p")).select(*keys, F.inline("_p"))
    if not stats:
        return out
    wanted, targets = [], {}
    for k, (n, _, _) in stats.items():
        for p in probs:
            pos = p * (n - 1)
            r0, r1 = math.floor(pos), math.ceil(pos)
            wanted.append((k, p, r0, r1, pos - r0))
            targets[(k, r0)] = targets[(k, r1)] = None
    values = select_ranks(base, keys, targets, "_x", stats, max_rows, buckets)
    rows = [(*k, float(p), float(_lerp(values[(k, r0)], values[(k, r1)], t))) for k, p, r0, r1, t in wanted]
    return out.unionByName(long_df.sparkSession.createDataFrame(rows, out.schema))


def describe_profile(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = (),
                     quantiles: bool = True, approx_accuracy: int | None = None) -> DataFrame:
    """Per (group, feature): n, mean, sample std, min, Q1, median, Q3, max.

    Output ``(group..., feature, n, mean, std, min_v, q1, q2, q3, max_v)``.
    Quartiles are exact (distributed rank selection) unless
    ``approx_accuracy`` is given: then ``percentile_approx`` in the same
    single aggregate (bounded sketch per key, rank error about 1/accuracy).
    """
    keys = [*group_cols, "feature"]
    long_df = unpivot_long(df, features, group_cols, keep_null=True)  # a feature without values has n = 0
    aggs = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
            F.min("x").alias("min_v"), F.max("x").alias("max_v")]
    if quantiles and approx_accuracy:
        qa = F.percentile_approx("x", [0.25, 0.5, 0.75], int(approx_accuracy))
        out = long_df.groupBy(*keys).agg(*aggs, qa.alias("_q"))
        return out.select(*keys, "n", "mean", "std", "min_v", *[F.col("_q")[i].alias(n) for i, n in
                                                               enumerate(("q1", "q2", "q3"))], "max_v")
    moments = long_df.groupBy(*keys).agg(*aggs)
    if not quantiles:
        return moments
    # written: n, min and max are also what the quantiles start from (no second counting pass)
    moments = written(moments, "profile-moments")
    sizes = moments.where(F.col("n") > 0).select(*keys, "n", F.col("min_v").alias("lo"), F.col("max_v").alias("hi"))
    qs = exact_quantiles(long_df, keys, [0.25, 0.5, 0.75], sizes=sizes)
    wide_q = qs.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(name)
                                     for p, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    q = wide_q.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "q1", "q2", "q3")
    out = moments.join(q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return out.select(*keys, "n", "mean", "std", "min_v", "q1", "q2", "q3", "max_v")


def group_moments(df: DataFrame, features: Sequence[str], group_col: str) -> DataFrame:
    """A02/A03/A16 in one pass: per (group, feature) n, mean and sample std."""
    return (unpivot_long(df, features, [group_col]).groupBy(group_col, "feature")
            .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")))


def group_counts(df: DataFrame, group_col: str) -> DataFrame:
    """Rows per group."""
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))


def metric_pivot(long_df: DataFrame, metric: str, group_col: str, groups: Sequence[str],
                 names: Sequence[str] | None = None) -> DataFrame:
    """Per feature, one column per group (explicit pivot values: no
    extra job to discover them)."""
    names = list(names) if names else list(groups)
    pv = long_df.groupBy("feature").pivot(group_col, list(groups)).agg(F.first(metric))
    return pv.select("feature", *[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)])


def profile_join(long_rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Per-feature profile values applied to each long row (broadcast
    equi-join on ``feature``; the profile has one row per feature)."""
    return long_rows.join(F.broadcast(profile), "feature")


def feature_correlation(df: DataFrame, a: str, b: str, group_col: str) -> DataFrame:
    """Pearson correlation of two features per group."""
    return df.groupBy(group_col).agg(F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance, upper triangle, in one aggregate (one scan)."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.covar_samp(cols[i], cols[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    stacked = [F.struct(F.lit(cols[i]).alias("fi"), F.lit(cols[j]).alias("fj"),
                        F.col(f"c_{i}_{j}").alias("cov")) for i, j in pairs]
    return row.select(F.explode(F.array(*stacked)).alias("s")).select("s.*")
