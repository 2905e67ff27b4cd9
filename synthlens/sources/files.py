"""Feature-table scans and sinks.

CSV is read with every column as text and columns chosen **by name**
(an explicit CSV schema is applied by position, which silently swaps
columns), then features go through ``try_cast`` to finite DOUBLE. Parquet
keeps its types; the same cleaning applies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.operators.clean import cast_features, drop_incomplete


def guess_format(spark: SparkSession, path: str) -> str:
    """``csv``/``parquet``/``json``/``orc`` from the path name, else from the
    names of the files inside the folder (Hadoop file system listing)."""
    for ext in ("csv", "parquet", "json", "orc"):
        if path.rstrip("/").endswith("." + ext):
            return ext
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        for ext in ("csv", "parquet", "json", "orc"):
            if any(n.endswith("." + ext) for n in names):
                return ext
    return "parquet"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or guess_format(spark, path)
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def scan_features(spark: SparkSession, path: str, features: Sequence[str], keep: Sequence[str] = (),
                  indexed: bool = False, fmt: str | None = None, missing: str = "error") -> DataFrame:
    """Scan, drop a leading unnamed index column (``indexed``),
    select ``keep`` columns and the features by name, features to DOUBLE.
    ``missing``: ``error`` raises on an absent feature, ``skip`` leaves it
    out, ``fill`` adds it as 0.0 (callers apply P08 at their point)."""
    df = read_table(spark, path, fmt)
    if indexed:
        df = df.drop(df.columns[0])
    absent = [f for f in features if f not in df.columns]
    if absent and missing == "error":
        raise ValueError(f"features missing from {path}: {absent}")
    present = [f for f in features if f in df.columns]
    df = df.select(*[c for c in keep if c in df.columns], *present)
    df = cast_features(df, present)
    if missing == "fill":
        df = df.withColumns({f: F.lit(0.0) for f in absent})
    return df


def scan_clean(spark: SparkSession, path: str, features: Sequence[str], keep: Sequence[str] = (),
               indexed: bool = False, fmt: str | None = None) -> DataFrame:
    """Scan, +/-inf and NaN to missing, drop rows missing any listed
    feature; every other column is kept."""
    df = read_table(spark, path, fmt)
    if indexed:
        df = df.drop(df.columns[0])
    df = cast_features(df, features)
    return drop_incomplete(df, features)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_available(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first existing path of an ordered candidate list."""
    return next((c for c in candidates if path_exists(spark, c)), None)


def write_sheet(df: DataFrame, path: str, index_col: str | None = None, fmt: str = "csv") -> str:
    """Write with a header (CSV) or as Parquet. ``index_col`` is
    written first under an empty header name (a row-index column)."""
    if index_col is not None:
        df = df.select(F.col(index_col).alias(""), *[c for c in df.columns if c != index_col])
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path
