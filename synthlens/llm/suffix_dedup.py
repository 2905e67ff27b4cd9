"""Removal of long repeated substrings with a multi-document
Burrows-Wheeler transform built column by column.

A window is a string of ``length`` bytes. A byte goes if a window that
covers it also starts anywhere else in the table. Windows are compared
exactly, by the common prefixes of a sorted collection of suffixes, without
sorting all suffixes of the corpus at one place:

1. *Anchors.* Every window has an anchor, its least ``GRAM``-byte substring
   by hash (the leftmost of equals). Equal windows have equal anchors at
   equal places, so only windows of one anchor need to be compared. Windows
   that follow each other mostly share their anchor; such a run is one row.
2. Anchors seen once are done. If all runs of an anchor have the same bytes
   around it, all their windows repeat. What remains are runs that share
   the anchor in different surroundings, where repeats begin and end.
3. These runs are cut into blocks of ``BLOCK`` windows. All windows of a
   block contain its core (the bytes common to them), so a block is a short
   string: some bytes, the core as one symbol, some bytes. Blocks whose core
   occurs once are done.
4. *Columns.* The strings of a task are a collection. Each round inserts one
   symbol per string, from the last to the first, and updates the sorted
   order of all suffixes inserted so far (the transform: a stable sort of
   the order by the preceding symbol) and the lengths of common prefixes of
   neighbours (one symbol more than the least between the two parents). The
   arrays are read front to back in each round. A window repeats if its
   suffix has at least ``length`` bytes in common with a neighbour, or if its
   string occurs more than once.
5. Repeated windows go back to their texts, where their bytes are removed.

A core with more than ``HOT`` different strings is not one task's work: its
strings are cut into single windows, which are counted.

Cases: null text is empty; texts under ``length`` bytes lose nothing;
repeated rows and equal texts of two documents repeat each other; a cut may
split a character, and then ``clean_text`` leaves out its rest; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import key_bits, may_hold, slices, written

LENGTH = 200
GRAM = 80
BLOCK = 16
HOT = 500
PIECE = 1 << 18  # windows of a text handled at once

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(9)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("i", _P_INV)):
            x = np.full(size, _U(base))
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of all substrings of a byte string by prefix sums."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (leftmost) in each window of ``width``."""
    n = len(values) - width + 1
    low = _U((1 << 20) - 1)
    packed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    pad = -len(packed) % width
    padded = np.concatenate([packed, np.full(pad, _U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)


def anchor_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, surroundings hash, first window, windows, anchor's
    distance from the first window) of the runs of a byte string."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    h = Hashes(data)
    los, counts, ats = [], [], []
    for s in range(0, n, PIECE):
        e = min(n, s + PIECE)
        starts = np.arange(s, e + length - gram)
        at = s + _sliding_argmin(h.of(starts, starts + gram), length - gram + 1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        los.append(s + cut)
        counts.append(np.diff(np.concatenate([cut, [e - s]])))
        ats.append(at[cut])
    lo, count, at = map(np.concatenate, (los, counts, ats))
    around = _mix(h.of(lo, lo + count + length - 1) + (at - lo).astype(np.uint64) * _U(_P) + count.astype(np.uint64))
    return h.of(at, at + gram), around, lo, count, at - lo


def run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, around, key, lo, n, at) of all runs of (key, text)."""
    names = ["h", "around", "key", "lo", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [anchor_runs(np.frombuffer(t.encode("utf-8"), np.uint8), length, gram)
                     for t in b.column(1).to_pylist()]
            if not found:
                continue
            h, around, lo, n, at = (np.concatenate(x) for x in zip(*found))
            key = np.repeat(b.column(0).to_numpy(), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(key),
                                              pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)),
                                              pa.array(at.astype(np.int32))], names=names)

    return docs.mapInArrow(run, "h long, around long, key long, lo int, n int, at int")


def blocks_of_runs(lo: np.ndarray, n: np.ndarray, at: np.ndarray, block: int = BLOCK):
    """(run, block number, first window, last window, core start) of the
    blocks of runs of ``n`` windows from ``lo`` whose anchors start at ``lo + at``."""
    least, most = (at - n + 1) // block, at // block
    count = most - least + 1
    run = np.repeat(np.arange(len(lo)), count)
    k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + least[run]
    core = (lo + at)[run] - k * block
    return run, k, np.maximum(lo[run], core - block + 1), np.minimum((lo + n - 1)[run], core), core


def _list_fields(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the named fields of a column of lists of structs."""
    return column.offsets.to_numpy(), [column.values.field(x).to_numpy() for x in names]


def block_rows(docs: DataFrame, length: int, gram: int, block: int = BLOCK) -> DataFrame:
    """(core, left, right, key, first) of the blocks of the runs in ``runs``
    of (key, text, runs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            core, left, right, keys, firsts = [], [], [], [], []
            off, (h, lo, n, at) = _list_fields(b.column(2), ["h", "lo", "n", "at"])
            for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own = slice(off[i], off[i + 1])
                r, k, first, last, start = blocks_of_runs(*(x[own].astype(np.int64) for x in (lo, n, at)), block)
                data = text.encode("utf-8")
                end = start + length - block + 1
                inner = Hashes(np.frombuffer(data, np.uint8)).of(start, end)
                core.append(_mix(inner + _mix(h[own][r].view(np.uint64)) + k.view(np.uint64)).view(np.int64))
                left += [data[f:a] for f, a in zip(first.tolist(), start.tolist())]
                right += [data[e:s + length] for e, s in zip(end.tolist(), last.tolist())]
                keys.append(np.full(len(r), key, np.int64))
                firsts.append(first)
            if core:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(core)), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                     pa.array(np.concatenate(keys)), pa.array(np.concatenate(firsts).astype(np.int32))],
                    names=["core", "left", "right", "key", "first"])

    return docs.mapInArrow(run, "core long, left binary, right binary, key long, first int")


def suffix_order(strings: list[np.ndarray], weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, position, common) of all suffixes of a collection in sorted
    order; ``common``: weight of the common prefix with the one before. One
    symbol of every string is inserted per round, the last one first."""
    m = len(strings)
    size = np.array([len(s) for s in strings])
    flat = np.concatenate(strings)
    off = np.concatenate([[0], np.cumsum(size)[:-1]])
    ends = (np.arange(m), size.copy(), np.zeros(m, np.int64))
    who, pos, common = ends
    for _ in range(int(size.max(initial=0))):
        parent = np.flatnonzero(pos > 0)
        symbol = flat[off[who[parent]] + pos[parent] - 1]  # the transform: what precedes each suffix
        order = np.argsort(symbol, kind="stable")
        parent, symbol = parent[order], symbol[order]
        least = _range_min(common, parent[:-1] + 1, parent[1:] + 1)
        inserted = np.zeros(len(parent), np.int64)
        inserted[1:] = np.where(symbol[1:] == symbol[:-1], weight(symbol[1:]) + least, 0)
        who, pos, common = (np.concatenate([ends[0], who[parent]]), np.concatenate([ends[1], pos[parent] - 1]),
                            np.concatenate([ends[2], inserted]))
    return who, pos, common


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start:end] where start < end, else 0, by doubling."""
    out = np.zeros(len(start), values.dtype)
    span = end - start
    level = np.full(len(start), -1)
    good = span > 0
    level[good] = np.floor(np.log2(span[good])).astype(int)
    table, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[start[at]], table[end[at] - width])
        if len(table) <= width:
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def repeated_in_collection(core: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray,
                           length: int = LENGTH, block: int = BLOCK) -> list[int]:
    """For each string (left bytes, core, right bytes) a bit mask of its
    repeated windows; bit i: the window that starts i bytes before the core."""
    _, rank = np.unique(core, return_inverse=True)
    kind = np.uint16 if len(core) < 65_000 else np.int32
    strings = [np.concatenate([np.frombuffer(a, np.uint8).astype(kind) + 1, np.array([257 + r], kind),
                               np.frombuffer(b, np.uint8).astype(kind) + 1]) for a, r, b in zip(left, rank, right)]
    who, pos, common = suffix_order(strings, lambda s: np.where(s > 256, length - block + 1, 1))
    hit = common >= length
    hit[:-1] |= hit[1:]
    masks = [0] * len(strings)
    n_left = np.array([len(x) for x in left])
    for w, i in zip(who[hit].tolist(), (n_left[who[hit]] - pos[hit]).tolist()):
        masks[w] |= 1 << i
    for w in np.flatnonzero(times > 1):
        masks[w] |= (1 << (len(left[w]) + 1)) - (1 << (block - 1 - len(right[w])))
    return masks


def _collections(strings: DataFrame, buckets: int, length: int, block: int) -> DataFrame:
    """(core, left, right, mask) of (core, left, right, times)."""
    def run(t: pa.Table) -> pa.Table:
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        masks = repeated_in_collection(t.column("core").to_numpy(), left, right, t.column("times").to_numpy(), length,
                                       block)
        return pa.table({"core": t.column("core"), "left": t.column("left"), "right": t.column("right"),
                         "mask": pa.array(masks, pa.int64())})

    return (strings.withColumn("bucket", F.pmod("core", F.lit(buckets))).groupBy("bucket")
            .applyInArrow(run, "core long, left binary, right binary, mask long"))


def _single_windows(strings: DataFrame, length: int, block: int) -> DataFrame:
    """The same for cores with very many strings: every window by itself,
    counted with map-side combining."""
    window = F.explode(F.sequence(F.lit(block - 1) - F.length("right"), F.length("left")))
    cut = strings.withColumn("i", window)
    cut = cut.withColumns({"a": F.expr("right(left, i)"), "b": F.expr(f"substring(right, 1, {block - 1} - i)")})
    cut = cut.withColumn("a", F.expr("substring(left, length(left) - i + 1, i)"))
    many = (cut.groupBy("core", "i", "a", "b").agg(F.sum("times").alias("_t")).where(F.col("_t") > 1).drop("_t"))
    return (cut.join(many, ["core", "i", "a", "b"]).groupBy("core", "left", "right")
            .agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK,
                   hot: int = HOT) -> DataFrame:
    """(key, spans) for the texts of (key, text) with repeated windows; key:
    hash of the text. A span with mask 0 is the windows that start in [lo,
    hi), else bit i of the mask is the window that starts at lo - i."""
    runs = written(run_rows(docs, length, gram), "repeat-anchors")
    # written, so that the join deals both sides anew and Spark can split a frequent anchor
    seen = written(runs.groupBy("h").agg(F.count("*").alias("c"), F.min("around").alias("x"), F.max("around").alias("y"))
                   .where(F.col("c") > 1).select("h", (F.col("x") == F.col("y")).alias("alike")), "repeat-seen")
    found = written(runs.select("h", "key", "lo", "n", "at").join(seen, "h")
                    .groupBy("key").agg(F.collect_set(F.struct("h", "lo", "n", "at", "alike")).alias("runs")), "repeat-runs")
    sure = found.select("key", F.explode(F.filter("runs", lambda r: r["alike"])).alias("r"))
    sure = sure.select("key", F.col("r.lo").alias("lo"), (F.col("r.lo") + F.col("r.n")).alias("hi"),
                       F.lit(0).cast("bigint").alias("mask"))
    open_ = (found.select("key", F.filter("runs", lambda r: ~r["alike"]).alias("runs")).where(F.size("runs") > 0))
    n_open = open_.count()
    spans = sure
    if n_open:
        texts = may_hold(docs.select("key", "text"), "key", key_bits(open_, "key", n_open))
        # equal texts have equal blocks; each row of a text counts, so copies stay separate rows here
        rows = written(block_rows(texts.join(open_, "key").select("key", "text", "runs"), length, gram, block),
                       "repeat-blocks")
        strings = rows.groupBy("core", "left", "right").agg(F.count("*").alias("times"))
        cores = strings.groupBy("core").agg(F.count("*").alias("_s"), F.sum("times").alias("_c")).where(F.col("_c") > 1)
        strings = written(strings.join(cores, "core").drop("_c"), "repeat-strings")
        n_strings = strings.count()
        few = _collections(strings.where(F.col("_s") <= hot), max(1, n_strings // 4000), length, block)
        many = _single_windows(strings.where(F.col("_s") > hot), length, block)
        masks = written(few.unionByName(many).where(F.col("mask") != 0), "repeat-masks")
        hit = (rows.select("key", "core", "left", "right", "first").join(masks, ["core", "left", "right"])
               .select("key", (F.col("first") + F.length("left")).alias("lo"), F.lit(0).alias("hi"), "mask"))
        spans = sure.unionByName(hit)
    return spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "mask")).alias("spans"))


def covered(n: int, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` bytes the windows of the spans cover."""
    span = mask == 0
    i, bit = np.nonzero((mask[~span][:, None] >> np.arange(63)) & 1)
    single = lo[~span][i] - bit
    edge = np.bincount(np.concatenate([lo[span], single]), minlength=n + 1)
    edge = edge - np.bincount(np.concatenate([hi[span] - 1, single]) + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def cut_texts(texts: pa.Array, spans: pa.Array, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(the bytes left, removed bytes, removed ranges) of each text."""
    off, (lo, hi, mask) = _list_fields(spans, ["lo", "hi", "mask"])
    for i, text in enumerate(texts.to_pylist()):
        data = text.encode("utf-8")
        own = slice(off[i], off[i + 1])
        if off[i] == off[i + 1]:
            yield data, 0, 0
            continue
        gone = covered(len(data), lo[own].astype(np.int64), hi[own].astype(np.int64), mask[own], length)
        starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        yield np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), starts


def _with_spans(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """Every row of ``docs`` in a struct, its text, and its spans; texts
    without repeats do not pass a shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64(text).alias("key"))
    spans = written(repeated_spans(rows.select("key", "text"), length, gram), "repeat-spans")
    bits = key_bits(spans, "key", spans.count())
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    return (may_hold(rows, "key", bits).join(spans, "key", "left").select("row", "text", "spans")
            .unionByName(may_hold(rows, "key", bits, False).select("row", "text", none)))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    rows = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", length, gram)
    rows = rows.select("row.doc_id", "text", "spans")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in
                                                    ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [(len(kept) + removed, removed, ranges, hashlib.sha256(kept).hexdigest())
                   for kept, removed, ranges in cut_texts(b.column(1), b.column(2), length)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]],
                                              pa.array(cols[3], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """The documents without their repeated bytes, every other column as it
    was (``chars_col``: set to the new length)."""
    rows = _with_spans(docs, text_col, length, gram)
    schema = T.StructType([rows.schema["row"], T.StructField("clean_text", T.StringType()),
                           T.StructField("clean_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [kept.decode("utf-8", "ignore") for kept, _, _ in cut_texts(b.column(1), b.column(2), length)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], names=schema.names)

    new = {text_col: F.col("clean_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.col("clean_chars").cast(docs.schema[chars_col].dataType)
    return rows.mapInArrow(run, schema).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
