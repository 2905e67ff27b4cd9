"""Report data (S08, S09): the numbers behind the comparison figure as
tables, and the load audit of every source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from synthlens.functions.numeric import greatest_of


def _audit_counts(label_ok: Column | None, features: Sequence[str]) -> dict[str, Column]:
    ok = label_ok if label_ok is not None else F.lit(True)
    complete = greatest_of(F.col(f).isNull().cast("int") for f in features) == 0
    return {"n_total": F.count(F.lit(1)), "n_label": F.count_if(ok), "n_complete": F.count_if(ok & complete)}


def load_audit(source: str, raw: DataFrame, label_ok: Column | None, features: Sequence[str],
               simulated: bool = False, sample_n: int | None = None) -> DataFrame:
    """One aggregate over a source: total rows, rows passing the label
    filter, rows also complete in every feature, and the rows a sample of
    ``sample_n`` would select; plus the 'simulated?' provenance flag."""
    row = raw.agg(*[c.alias(k) for k, c in _audit_counts(label_ok, features).items()])
    sel = F.col("n_complete") if sample_n is None else F.least(F.col("n_complete"), F.lit(sample_n)).cast("bigint")
    return row.select(F.lit(source).alias("source"), "n_total", "n_label", "n_complete", sel.alias("n_selected"),
                      F.lit(bool(simulated)).alias("simulated"))


def write_report_tables(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write each report table as Parquet under ``root`` and return
    ``(table, rows)``, counted by the tasks that write."""
    counts = []
    for name, df in tables.items():
        back = written_counted(df, f"{root.rstrip('/')}/{name}", rows=F.count(F.lit(1)))[1]
        counts.append((name, back["rows"]))
    return df.sparkSession.createDataFrame(counts, "table string, rows bigint")


def written_counted(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written to ``path`` and read again, and aggregates of its rows
    gathered by the writing tasks: nothing is read a second time for them."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def load_audited(source: str, raw: DataFrame, label_ok: Column | None, features: Sequence[str], path: str,
                 simulated: bool = False, sample_n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S09 while the load is written: ``(loaded, audit)``. ``loaded`` is
    ``raw`` under ``path``; ``audit`` is the row of ``load_audit``, gathered
    as the rows pass, so the source is read once for both."""
    loaded, seen = written_counted(raw, path, **_audit_counts(label_ok, features))
    n = seen["n_complete"] if sample_n is None else min(seen["n_complete"], sample_n)
    audit = raw.sparkSession.createDataFrame(
        [(source, seen["n_total"], seen["n_label"], seen["n_complete"], n, bool(simulated))],
        "source string, n_total bigint, n_label bigint, n_complete bigint, n_selected bigint, simulated boolean")
    return loaded, audit
