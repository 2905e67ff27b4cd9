"""Exact top-k by integer inner product with a vector-approximation file.

Vectors become integers, floor(scale * x). The approximation of a vector is
one byte per dimension, the number of its cell on a uniform grid between
the dimension's least and greatest value. For a query q and a vector in a
cell with centre c and half width h (the same for all cells of a
dimension), the inner product lies in q.c -+ |q|.h, so one matrix product
over the bytes gives the bounds of a whole block.

1. The approximations are scanned; each task keeps every query's k best
   lower bounds, and the k-th best of all tasks is the query's threshold.
2. A second scan keeps the vectors whose upper bound reaches the threshold.
3. Exact vectors are read in order of their bounds: first the best
   ``FIRST_READ`` per query; their k-th exact score then decides which of
   the others can still matter, and only those are read.

Queries go through in blocks of bounded size, each broadcast; candidates are
never collected. Equal vectors score alike and ties go to the smaller id,
so of a group of equal vectors only its k + 1 smallest ids can appear (one
may be the query); the rest are set aside before the scan, which changes no
result.

Cases: a vector that is null, empty, has a null or non-finite component, or
not the most common length (ties: the longer) takes no part, nor does a
null id; a query id that occurs twice is asked with its least vector; rows
repeated with one id and one vector count once; fewer than k candidates
give as many rows as there are; an empty table gives an empty result. Only
the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import slices, written

SCALE = 1024
CELLS = 256
QUERY_BLOCK = 2048
BOUNDS_AT_ONCE = 1 << 21  # bounds of queries and vectors that a task holds at a time (16 MB)
FIRST_READ = 4  # times k

_VECTORS = "vec_id long, ivec binary, dim int"
_SLACK = 1e-3  # relative room for rounding in the bounds


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, ivec: 64-bit integers as bytes, dim) of the vectors that take part."""
    src = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    src = src.where(F.col("vec_id").isNotNull() & (F.size("v") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values
                if x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(np.floor(scale * x).astype("<i8").tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()),
                                              pa.array(dims, pa.int32())], names=["vec_id", "ivec", "dim"])

    return src.mapInArrow(run, _VECTORS)


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.empty((0, 0), dtype)


def _ranges(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every dimension (``dim`` rows reach the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = None, None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), "<i8")
                lo = m.min(axis=0) if lo is None else np.minimum(lo, m.min(axis=0))
                hi = m.max(axis=0) if hi is None else np.maximum(hi, m.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi)],
                                             names=["d", "lo", "hi"])

    rows = (vectors.select("ivec").mapInArrow(run, "d int, lo long, hi long")
            .groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect())
    return np.array([r["lo"] for r in rows], float), np.array([r["hi"] for r in rows], float)


def approximate(vectors: DataFrame, lo: np.ndarray, step: np.ndarray) -> DataFrame:
    """(vec_id, ivec, code): the cell number of every component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), "<i8")
            code = np.clip((m - lo) // step, 0, CELLS - 1).astype(np.uint8) if len(m) else np.empty((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in code], pa.binary())],
                                             names=["vec_id", "ivec", "code"])

    return vectors.select("vec_id", "ivec").mapInArrow(run, "vec_id long, ivec binary, code binary")


def top_k(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score). ``queries``: condition on ``vec_id``
    naming the query rows."""
    spark = df.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score long"
    vectors = written(integer_vectors(df, id_col, vec_col, scale).distinct(), "va-integers")
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out_schema)
    dim = dims[0]["dim"]
    vectors = vectors.where(F.col("dim") == dim)
    lo, hi = _ranges(vectors, dim)
    step = np.maximum(1.0, np.ceil((hi - lo + 1) / CELLS))
    copies = Window.partitionBy("ivec").orderBy("vec_id")
    distinct = vectors.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    va = written(approximate(distinct, lo, step), "va-file")
    asked = vectors.where(queries).groupBy("vec_id").agg(F.min("ivec").alias("ivec"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    results = []
    for block in range(blocks):
        rows = sorted((r["vec_id"], bytes(r["ivec"])) for r in asked.where(F.col("_block") == block).collect())
        if rows:
            ids = np.array([r[0] for r in rows], np.int64)
            q = np.stack([np.frombuffer(r[1], "<i8") for r in rows])
            results.append(_search(va, ids, q, lo, step, k))
    if not results:
        return spark.createDataFrame([], out_schema)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _search(va: DataFrame, ids: np.ndarray, q: np.ndarray, lo: np.ndarray, step: np.ndarray, k: int) -> DataFrame:
    spark = va.sparkSession
    qf = q.astype(float)
    base = qf @ (lo + (step - 1) / 2)
    radius = np.abs(qf) @ ((step - 1) / 2)
    radius = radius + _SLACK * (1 + radius)
    sent = spark.sparkContext.broadcast((ids, (qf * step).T.copy(), base, radius))

    at_once = max(1, BOUNDS_AT_ONCE // len(ids))

    def best_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, centre, r = sent.value
        kept = np.full((len(own), 0), -np.inf)
        for b in slices(batches, at_once):
            if not b.num_rows:
                continue
            low = (_matrix(b.column(1), "u1").astype(float) @ weights).T + (centre - r)[:, None]
            low[own[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            kept = np.concatenate([kept, low], axis=1)
            if kept.shape[1] > k:
                kept = -np.partition(-kept, k - 1, axis=1)[:, :k]
        if kept.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, kept.shape[1])), pa.array(kept.ravel())],
                                             names=["query_id", "bound"])

    bounds = va.select("vec_id", "code").mapInArrow(best_bounds, "query_id long, bound double")
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    kth = {r["query_id"]: r["bound"] for r in bounds.withColumn("n", F.row_number().over(w)).where(F.col("n") == k)
           .select("query_id", "bound").collect()}  # one number per query of the block
    limits = spark.sparkContext.broadcast(np.array([kth.get(int(i), -np.inf) for i in ids]))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, centre, r = sent.value
        for b in slices(batches, at_once):
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            high = (_matrix(b.column(1), "u1").astype(float) @ weights).T + (centre + r)[:, None]
            i, j = np.nonzero((high >= limits.value[:, None]) & (own[:, None] != at[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(at[j]), pa.array(high[i, j])],
                                             names=["query_id", "vec_id", "bound"])

    found = va.select("vec_id", "code").mapInArrow(reach, "query_id long, vec_id long, bound double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id")
    found = written(found.withColumn("_n", F.row_number().over(order)), "va-candidates")
    sent_q = spark.sparkContext.broadcast((ids, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = sent_q.value
        for b in batches:
            if not b.num_rows:
                continue
            at = np.searchsorted(own, b.column(0).to_numpy())
            score = np.einsum("ij,ij->i", vectors[at], _matrix(b.column(2), "<i8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)],
                                             names=["query_id", "vec_id", "score"])

    def read(candidates: DataFrame) -> DataFrame:
        pairs = candidates.join(va.select("vec_id", "ivec"), "vec_id").select("query_id", "vec_id", "ivec")
        return pairs.mapInArrow(exact, "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = written(read(found.where(F.col("_n") <= FIRST_READ * k)), "va-first")
    sure = first.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == k).select("query_id", F.col("score").alias("_kth"))
    later = (found.where(F.col("_n") > FIRST_READ * k).join(sure, "query_id", "left")
             .where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth"))))
    scores = first.unionByName(read(later)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
