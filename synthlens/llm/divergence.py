"""How far each source's use of terms is from the other sources of its
language and from the language as a whole, counted exactly.

A term is a longest run of bytes that are letters A-Z, a-z or not ASCII
(``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``), A-Z lower-cased. Each language
keeps the terms that occur in at least ``min_docs`` of its documents (V of
them). A group is the documents of one (lang, source). Group and language
give each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the kept
terms' occurrences there; two of these lie f = floor((p - q)^2 / (p + q))
apart.

Terms are counted by length-bucketed packing. The texts of a batch are one
byte array, its documents ordered by group. A term of at most 8 bytes is one
64-bit word, one of at most 16 bytes two, zero bytes behind it (no term holds
one); the words are ordered by a stable radix sort over 16-bit digits, so
that equal terms, then groups, then documents lie together and runs of them
are counts and document counts. Longer terms go to buckets by length, each
ordered by its bytes. Spark adds up the runs of all tasks.

Distances of sources: kept terms are dealt to blocks of about
``BLOCK_TERMS``, sources to tiles of about ``TILE``; a task holds the p of one
block for two tiles and returns one partial sum per pair of sources. Terms
that neither of the two sources has need no rows: all of them lie equally
far apart.

Cases: null texts, languages and sources are empty strings; texts without
terms still make their group; a language without kept terms has distances 0;
repeated rows are documents of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlens.llm.common import written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
CHUNK = 4 << 20  # bytes of text that are sorted at once
TILE = 64  # sources of a tile, on average at most
BLOCK_TERMS = 8192  # terms of a block, on average at most

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0
_FOLD[0x41:0x5B] += 32
_MASK = np.array([((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(9)], np.uint64)  # the first k bytes of a word


# --- terms of a batch ------------------------------------------------------------------------------------------
def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start of each text and the end, all bytes) of a string column without nulls."""
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def term_spans(folded: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of non-zero bytes; none crosses a cut."""
    on = folded != 0
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    inner = cuts[(cuts > 0) & (cuts < len(folded))]
    first[inner] = on[inner]
    last[inner - 1] = on[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by the 64-bit words, the first most significant: one pass
    per 16-bit digit, the lowest first (numpy sorts such digits by radix)."""
    order = np.arange(len(words[0]))
    for w in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (w >> np.uint64(shift)).astype(np.uint16).take(order)
            if len(digit) and digit.min() != digit.max():
                order = order.take(np.argsort(digit, kind="stable"))
    return order


def term_buckets(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bucket: (which terms, in the bucket's order; whether each equals
    the one before; the bytes of each as a row, zeros behind)."""
    padded = np.concatenate([folded, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))  # the 8 bytes from each place on
    for low, high in ((0, 8), (8, 16)):
        which = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(which):
            continue
        at, n = starts[which], lengths[which]
        words = [eight[at + k].astype(np.uint64) & _MASK[np.minimum(n - k, 8)] for k in range(0, high, 8)]
        order = radix_order(words)
        words = [w.take(order) for w in words]
        same = np.ones(len(order), bool)
        same[0] = False
        for w in words:
            same[1:] &= w[1:] == w[:-1]
        yield which.take(order), same, np.stack(words, axis=1).astype(">u8").view(np.uint8)
    width = 32
    while (lengths > width // 2).any():
        which = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        if len(which):
            rows = np.zeros((len(which), width), np.uint8)
            for row, s, n in zip(rows, starts[which].tolist(), lengths[which].tolist()):
                row[:n] = folded[s:s + n]
            keys = rows.view(f"S{width}").ravel()  # bytes as they are compared; no term holds a zero
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            yield which.take(order), np.concatenate([[False], keys[1:] == keys[:-1]]), rows
        width *= 2


def term_runs(texts: pa.Array, groups: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents) of texts that are ordered by
    group: one run for each term of each group, bucket by bucket."""
    off, raw = text_bytes(texts)
    folded = _FOLD.take(raw)
    starts, lengths = term_spans(folded, off)
    doc = np.searchsorted(off, starts, "right") - 1
    for which, same, rows in term_buckets(folded, starts, lengths):
        d = doc.take(which)
        g = groups.take(d)
        new = ~same
        new[1:] |= g[1:] != g[:-1]
        fresh = new.copy()
        fresh[1:] |= d[1:] != d[:-1]
        first = np.flatnonzero(new)
        n = lengths.take(which[first])
        data = rows[first]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data[data != 0]))
        yield terms, g[first], np.diff(np.append(first, len(which))), np.add.reduceat(fresh.astype(np.int64), first)


def term_rows(src: DataFrame) -> DataFrame:
    """(lang, source, term, c, d) of (lang, source, text): the runs of each chunk of texts."""
    names = ["lang", "source", "term", "c", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.concatenate([[0], np.cumsum(np.diff(text_bytes(b.column(2))[0]))])
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + CHUNK, "right")) - 1)
                part = pa.Table.from_batches([b.slice(i, j - i)])
                part = part.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
                lang, source = part.column(0).combine_chunks(), part.column(1).combine_chunks()
                codes = [c.dictionary_encode().indices.to_numpy() for c in (lang, source)]
                new = np.zeros(len(part), bool)
                for c in codes:
                    new[1:] |= c[1:] != c[:-1]
                groups = np.cumsum(new)
                heads = np.concatenate([[0], np.flatnonzero(new)])
                for terms, g, c, d in term_runs(part.column(2).combine_chunks(), groups):
                    at = pa.array(heads.take(g))
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(at), source.take(at), terms, pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=names)
                i = j
            pa.default_memory_pool().release_unused()

    return src.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, c long, d long")


# --- distances -------------------------------------------------------------------------------------------------
def share(count: Column | int, n: Column, v: Column) -> Column:
    """p of a term: exact, in decimals of 38 digits; 1 without kept terms."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (F.lit(count) if isinstance(count, int) else count).cast("decimal(20,0)")
             + F.lit(2 * SCALE).cast("decimal(11,0)"))
    floor = F.call_function("div", whole, (n + 2 * v).cast("decimal(20,0)"))
    return F.when(v > 0, 1 + floor).otherwise(F.lit(1)).cast("bigint")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile_sums(key: tuple, t: pa.Table) -> pa.Table:
    """Partial sums of one block of terms for the sources of two tiles. Rows
    without a term name the sources and their p of an absent term."""
    left_tile, right_tile, block = (k.as_py() for k in key[1:])
    gid, tile, tid, p, v = (t.column(c) for c in ("gid", "tile", "tid", "p", "v"))
    absent = tid.is_null().to_numpy().astype(bool)
    gid, tile, p = (c.to_numpy() for c in (gid, tile, p))
    order = np.flatnonzero(absent)[np.argsort(gid[absent], kind="stable")]
    sources, tiles, p0 = gid[order], tile[order], p[order]
    n_terms = int(v.to_numpy()[order[0]])
    ids, term = np.unique(tid.filter(pa.array(~absent)).to_numpy(), return_inverse=True)
    table = np.repeat(p0[None], len(ids), axis=0)
    table[term, np.searchsorted(sources, gid[~absent])] = p[~absent]
    left, right = np.flatnonzero(tiles == left_tile), np.flatnonzero(tiles == right_tile)
    a, b, sums = [], [], []
    for i in left:
        others = right[right > i] if left_tile == right_tile else right
        far = _apart(p0[i], p0[others])
        s = _apart(table[:, i:i + 1], table[:, others]).sum(axis=0) - len(ids) * far
        if block == 0:
            s = s + n_terms * far
        a.append(np.full(len(others), sources[i]))
        b.append(sources[others])
        sums.append(s)
    a, b, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, sums))
    return pa.table({"a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "s": np.concatenate([sums, sums]).astype(np.int64)})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE,
                      block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). ``pair``: every other source
    of the language, by distance; ``term``: the ``top_terms`` terms that the
    source uses more than its language and that lie farthest from it."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                        for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = written(term_rows(src).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")),
                     "divergence-counts")
    terms = (counts.groupBy("lang", "term").agg(F.sum("c").alias("total"), F.sum("d").alias("d"))
             .where(F.col("d") >= min_docs).select("lang", "term", "total", F.monotonically_increasing_id().alias("tid")))
    terms = written(terms, "divergence-terms")  # written once, so the numbers hold
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    kept = written(counts.drop("d").join(terms, ["lang", "term"]), "divergence-kept")
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    found = src.select("lang", "source").distinct()
    sizes = found.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    groups = (found.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
              .na.fill(0, ["n", "v", "n_lang"])
              .select("lang", "source", "n", "v", "n_lang", "tiles", F.pmod(F.xxhash64("source"), "tiles").alias("tile"),
                      F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).alias("blocks"),
                      F.monotonically_increasing_id().alias("gid")))
    groups = written(groups, "divergence-groups")
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))

    # terms that stand out
    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    stand_out = (rows.withColumn("q", q).where(F.col("p") > F.col("q"))
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
                 .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms))

    # pairs of sources
    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        return df.select("lang", F.least("tile", "_t").alias("i"), F.greatest("tile", "_t").alias("j"), "block", "gid",
                         "tile", "tid", "p", "v")

    named = groups.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)),
                                "tid": F.lit(None).cast("bigint"), "p": share(0, F.col("n"), F.col("v"))})
    placed = rows.withColumn("block", F.pmod(F.xxhash64("tid"), "blocks"))
    sums = (dealt(named).unionByName(dealt(placed)).groupBy("lang", "i", "j", "block")
            .applyInArrow(tile_sums, "a long, b long, s long").groupBy("a", "b").agg(F.sum("s").alias("value")))
    first = groups.select(F.col("gid").alias("a"), "lang", "source")
    other = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    pairs = (sums.join(first, "a").join(other, "b")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(ranked)))
    return pairs.unionByName(stand_out)
