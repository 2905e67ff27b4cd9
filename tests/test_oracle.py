"""Every registered query against its DuckDB twin at sf0.001 (names, row
count, sorted values), and the rows-only queries for a stable schema."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(v.item() if hasattr(v, "item") else v)


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["feature", "jsd"] and df.count() == 4


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, sf_small, name):
    sdf = queries()[name](spark, sf_small)
    srows = sdf.collect()
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    idx = [dcols.index(c) for c in sdf.columns]
    a = sorted(tuple(norm(v) for v in r) for r in srows)
    b = sorted(tuple(norm(r[i]) for i in idx) for r in drows)
    assert a == b


def test_every_query_has_oracle_or_is_rows_only():
    from __spark_entry__ import ROWS_ONLY

    from synthlens.plans.queries import QUERIES

    assert set(QUERIES) == (set(oracle_sql()) & set(QUERIES)) | set(ROWS_ONLY)
