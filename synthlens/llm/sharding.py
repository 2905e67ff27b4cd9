"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of all slots of a prime-sized table
(start and step derived from its name, so the order is a permutation). The
shards take turns; at its turn a shard claims the first free slot of its
order. A row's key hashes to a slot, and the slot names the shard: one
look-up, whatever the number of shards. The table's size is a parameter
(not data), so broadcasting it is bounded. Adding or removing one shard
moves few keys besides those of that shard.

Cases: a null key is placed like the text ``null``; an empty table gives an
empty result; repeated keys go to one shard; only the key column and the
columns named in ``carry`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlens.llm.common import hex_key

TABLE_SIZE = 65_537  # prime, about 1000 slots for each of 64 shards


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


@lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> np.ndarray:
    """Index of the owning shard for each slot. ``weights``: turns of each
    shard per round (1 each by default)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    turns = weights or (1,) * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or max(turns) == 0:
        raise ValueError("one weight per shard, not all zero")
    place = [_number("start", s) % size for s in shards]
    step = [_number("step", s) % (size - 1) + 1 for s in shards]
    owner = np.full(size, -1, dtype=np.int32)
    left = size
    while left:
        for i, times in enumerate(turns):
            for _ in range(times):
                if not left:
                    break
                while owner[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % size
                owner[place[i]] = i
                left -= 1
    owner.setflags(write=False)
    return owner


def slot_of(key: Column, size: int, seed: int = 0) -> Column:
    """Slot of a key: the first 60 bits of md5(seed:key) modulo the table size."""
    h = hex_key(F.lit(seed), key)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE,
                  weights: Sequence[int] | None = None, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, slot, shard_index, shard): a map-side join with the
    broadcast table (``size`` rows), no shuffle."""
    owner = lookup_table(tuple(shards), size, tuple(weights) if weights else None)
    rows = [(i, int(o), shards[o]) for i, o in enumerate(owner)]
    places = df.sparkSession.createDataFrame(rows, "slot int, shard_index int, shard string")
    keyed = df.select(key, *carry).withColumn("slot", slot_of(F.col(key), size, seed))
    return keyed.join(F.broadcast(places), "slot").select(key, *carry, "slot", "shard_index", "shard")


def write_shards(assigned: DataFrame, path: str, parts_per_shard: int = 8) -> None:
    """One folder per shard; every shard is dealt over ``parts_per_shard``
    tasks by a hash of the whole row, so a large shard is not one task."""
    n_shards = max(1, assigned.sparkSession.sparkContext.defaultParallelism)
    salted = assigned.withColumn("_part", F.pmod(F.xxhash64(*assigned.columns), F.lit(parts_per_shard)))
    (salted.repartition(n_shards * parts_per_shard, "shard", "_part").drop("_part")
     .write.partitionBy("shard").parquet(path))
