"""Helpers shared by the operators: the word rule, table access, scratch
tables in the session's shared checkpoint folder, a bounded membership
filter and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.session import scratch_dir

# A word: a longest run without space, tab, line feed, vertical tab, form feed or return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh shared scratch folder and read again:
    lineage ends there, so a lost executor costs no recomputation and a
    non-trivial plan is not evaluated twice."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes (``bytes.split`` cuts at exactly
    the six separators; ``bytes.lower`` touches A-Z only)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to few rows, so that a worker holds few texts as
    Python objects at a time; what Arrow no longer needs goes back after
    each batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        pa.default_memory_pool().release_unused()


def ascii_lower_col(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words_col(c: Column) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def hex_key(*parts: Column) -> Column:
    """md5 of the parts joined by ':' (null as the word null): the same on any engine and layout."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null id: text 'null')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % m


# --- a bounded membership filter -------------------------------------------------------------------------------
MAX_BITS = 1 << 26  # 8 MB, whatever the data


def key_bits(keys: DataFrame, col: str, n_keys: int) -> np.ndarray:
    """A bit map (as bytes) that holds every key of ``col``, a 64-bit hash:
    about 16 bits per key, at most ``MAX_BITS``. It only spares later
    shuffles the rows that are surely not wanted; what passes may hold a few
    others."""
    bits = 1 << 16
    while bits < 16 * n_keys and bits < MAX_BITS:
        bits *= 2
    words = (keys.select(F.expr(f"cast(shiftright(pmod({col}, {bits}L), 6) AS INT)").alias("w"),
                         F.expr(f"shiftleft(1L, cast(pmod({col}, 64L) AS INT))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # at most MAX_BITS / 64 rows
    out = np.zeros(bits // 64, "<i8")
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint8)


def held(keys: np.ndarray, bit_map: np.ndarray) -> np.ndarray:
    """Which keys may be in the map."""
    at = keys % np.int64(8 * len(bit_map))
    return ((bit_map[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def may_hold(df: DataFrame, col: str, bit_map: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows whose key may be (``wanted``) or surely is not in the map."""
    sent = df.sparkSession.sparkContext.broadcast(bit_map)
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held(b.column(at).to_numpy(), sent.value) == wanted))

    return df.mapInArrow(run, df.schema)


# --- connected components --------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the undirected ``edges`` (a, b) the
    smallest node it can reach. Each round links a node's larger neighbours
    to its smallest neighbour, then the smaller ones likewise; both halves
    keep the components and shorten paths. Every round is a written table,
    so lineage stays short; no task holds a component."""
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if larger:
            both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m"))
        joined = both.join(least, F.col("a") == F.col("_a"))
        if larger:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
                joined.select("a", F.col("_m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where(F.col("a") != F.col("b")).distinct(), "edges")
    while True:
        following = written(star(star(current, True), False), "edges")
        n, m = current.count(), following.count()
        if n == m and not current.exceptAll(following).take(1):
            break
        current = following
    pairs = following.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return pairs.unionByName(pairs.select(F.col("label").alias("node"), "label").distinct())


def split_components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the undirected ``edges`` (a, b) the
    smallest node it can reach. Each round links a node's larger neighbours
    to its smallest neighbour, then the smaller ones likewise; both halves
    keep the components and shorten paths. Every round is a written table,
    so lineage stays short. The smallest neighbours are a written table of
    their own: the join deals both sides anew, and Spark can split a centre
    with very many neighbours over tasks."""
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if larger:
            both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals both sides anew and Spark can split a frequent centre
        least = written(both.groupBy("a").agg(F.min("b").alias("_m"))
                        .select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m")), "edge-least")
        joined = both.join(least, F.col("a") == F.col("_a"))
        if larger:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
                joined.select("a", F.col("_m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def digest(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first())

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = digest(current)
    while True:
        following = written(star(star(current, True), False), "edges")
        now = digest(following)
        if seen == now and not current.exceptAll(following).take(1):
            break
        current, seen = following, now
    pairs = following.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return pairs.unionByName(pairs.select(F.col("label").alias("node"), "label").distinct())
