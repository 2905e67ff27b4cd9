"""Projections, filters and repairs on feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlens.functions.numeric import finite_or_null, greatest_of, to_double

# Label values and the default endpoints of real and synthetic rows.
SSH = "ssh"
NON_SSH = "non-ssh"
REAL_ENDPOINT = ("0.0.0.0", 0)
SYNTH_ENDPOINT = ("255.255.255.255", 1)
DEST_COL = "Destination"
PORT_COL = "Destination Port"


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The fixed feature list, in order (plus ``keep`` columns first)."""
    return df.select(*keep, *features)


def label_filter(df: DataFrame, label_col: str, value: str = SSH, case_insensitive: bool = False) -> DataFrame:
    """P02 exact / P03 case-insensitive (value cast to text first) label filter."""
    c = F.col(label_col).cast("string")
    if case_insensitive:
        return df.where(F.lower(c) == value.lower())
    return df.where(c == value)


def resolve_label_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present in the schema, or None."""
    return next((c for c in candidates if c in df.columns), None)


def filter_by_resolved_label(df: DataFrame, candidates: Sequence[str], value: str = SSH,
                             case_insensitive: bool = False) -> DataFrame:
    """P04 + P02/P03: filter on the first present label column; none -> unchanged."""
    col = resolve_label_column(df, candidates)
    return df if col is None else label_filter(df, col, value, case_insensitive)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in ``subset`` (all columns if None)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN, +inf and -inf to NULL in the given numeric columns."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c in cols})


def cast_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features to finite DOUBLE (bad text, NaN, inf -> NULL)."""
    return df.withColumns({c: to_double(F.col(c)) for c in features})


def fill_missing_features(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    """A feature absent from the schema becomes a constant column."""
    missing = [f for f in features if f not in df.columns]
    return df.withColumns({f: F.lit(float(value)) for f in missing}) if missing else df


def default_endpoint(df: DataFrame, ip: str, port: int, overwrite: bool = False) -> DataFrame:
    """Endpoint columns set to constants when absent (or always)."""
    if not overwrite and DEST_COL in df.columns:
        return df
    return df.withColumns({DEST_COL: F.lit(ip), PORT_COL: F.lit(int(port))})


def mark_synthetic(df: DataFrame, label_col: str) -> DataFrame:
    """P09 for synthetic rows: label forced to ssh, dummy endpoint."""
    return default_endpoint(df.withColumn(label_col, F.lit(SSH)), *SYNTH_ENDPOINT, overwrite=True)


def auto_rescale(df: DataFrame, features: Sequence[str], threshold: float = 2.0,
                 factor: float = 100.0) -> DataFrame:
    """If the max over all features and rows is <= threshold, scale
    every feature by ``factor``. The global max is a one-row aggregate joined
    back (broadcast, one row); an empty input has a NULL max: no rescale."""
    gmax = df.agg(F.max(greatest_of(F.col(f) for f in features)).alias("_gmax"))
    scaled = df.crossJoin(F.broadcast(gmax))
    flag = F.coalesce(F.col("_gmax") <= F.lit(threshold), F.lit(False))
    return scaled.withColumns(
        {f: F.when(flag, F.col(f) * F.lit(factor)).otherwise(F.col(f)) for f in features}
    ).drop("_gmax")


def clip_to_profile(df: DataFrame, profile: DataFrame, features: Sequence[str],
                    lo_factor: float = 0.95, hi_factor: float = 1.05) -> DataFrame:
    """Clip each feature to [lo_factor*min, hi_factor*max] of a
    profile (long form ``feature, min_v, max_v``). The bounds are one row per
    feature, pivoted to a single row and broadcast. Drop incomplete rows
    first: ``least``/``greatest`` turn NULL into a bound."""
    spread = profile.where(F.col("feature").isin(list(features))).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("min_v"))).alias(f"_lo_{i}") for i, f in enumerate(features)],
        *[F.max(F.when(F.col("feature") == f, F.col("max_v"))).alias(f"_hi_{i}") for i, f in enumerate(features)],
    )

    def bound(name: str, feature: str, factor: float) -> Column:
        missing = F.raise_error(F.lit(f"the profile has no bounds for {feature}")).cast("double")
        return (F.coalesce(F.col(name), missing) * factor).alias(name)

    # checked and scaled in the one row, before it is sent
    bounds = spread.select(*[bound(f"_lo_{i}", f, lo_factor) for i, f in enumerate(features)],
                           *[bound(f"_hi_{i}", f, hi_factor) for i, f in enumerate(features)])
    out = df.crossJoin(F.broadcast(bounds))
    out = out.withColumns({f: F.greatest(F.least(F.col(f), F.col(f"_hi_{i}")), F.col(f"_lo_{i}"))
                           for i, f in enumerate(features)})
    return out.drop(*[f"_lo_{i}" for i in range(len(features))], *[f"_hi_{i}" for i in range(len(features))])


def endpoint_key(df: DataFrame, ip_col: str = DEST_COL, port_col: str = PORT_COL,
                 out: str = "endpoint") -> DataFrame:
    """``"<ip>:<port>"``; a NULL part prints as ``nan``."""
    ip = F.coalesce(F.col(ip_col).cast("string"), F.lit("nan"))
    port = F.coalesce(F.col(port_col).try_cast("double").cast("bigint").cast("string"), F.lit("nan"))
    return df.withColumn(out, F.concat(ip, F.lit(":"), port))


def feature_presence(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """P14 evidence: per feature, how many rows carry a value (0 when the
    column is absent). One aggregate, one row per feature."""
    present = [f for f in features if f in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f)).alias(f"_n_{i}") for i, f in enumerate(present)])
    stacked = [F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                        (F.col(f"_n_{present.index(f)}") if f in present else F.lit(0).cast("bigint")).alias("n_present"))
               for i, f in enumerate(features)]
    return (row.select("_rows", F.explode(F.array(*stacked)).alias("s"))
            .select(F.col("s.pos").alias("pos"), F.col("s.feature").alias("feature"),
                    F.col("s.n_present").alias("n_present"), F.col("_rows").alias("n_rows")))


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Abort if a feature is absent from every record; else drop the
    rows missing any feature (P05)."""
    counts = {r["feature"]: r["n_present"] for r in feature_presence(df, features).collect()}
    missing = [f for f in features if counts.get(f, 0) == 0]
    if missing:
        raise ValueError(f"features absent from every record: {missing}")
    return drop_incomplete(df.select(*[c for c in df.columns]), subset=list(features))
