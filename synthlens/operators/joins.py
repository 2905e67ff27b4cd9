"""Joining a large table to a small aggregated one.

A per-key aggregate (one row per session, slice, batch or endpoint) is often
small, but its size grows with the data. It is written once to the shared
scratch folder, so Spark knows its size in bytes when it plans the join: it
broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
(splitting skewed keys) above. Nothing stays cached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlens.session import scratch_dir

BROADCAST_ROWS = 50_000  # per-key rows that are sent to every executor, at most


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with ``small`` written first, so that its size decides the plan."""
    return big.join(written(small, "join-side"), on, how)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_keys(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of few narrow rows per key, where a NULL key equals
    a NULL key. ``small`` is written and counted: up to ``BROADCAST_ROWS``
    rows it is broadcast, so that ``big`` is not shuffled by few keys; beyond
    that both sides are shuffled by them. The keys come out once."""
    small = written(small, "join-keys")
    small = small.toDF(*[f"_k_{c}" if c in keys else c for c in small.columns])
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return big.join(F.broadcast(small) if few else small, same, how).drop(*[f"_k_{k}" for k in keys])
