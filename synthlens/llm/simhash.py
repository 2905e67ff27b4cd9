"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: its word shingles (A-Z lower-cased words,
``n_words`` of them joined by spaces, repeats included; fewer words: all as
one) are hashed by XXH64 with seed 42, and a bit is 1 if more than half of
the hashes have it. Two fingerprints link if at most ``radius`` bits differ.

1. The distinct fingerprints are counted by pairs of bits; correlated bits
   are put into the same of m partitions. m is the number for which probes
   and foretold candidates cost least.
2. If thresholds t_1..t_m of at least -1 sum up to radius - m + 1, then two
   fingerprints that link differ in at most t_i bits of some partition i.
   Each fingerprint gets thresholds of its own: dynamic programming over the
   partitions takes those with the least cost of probes and candidates.
   Candidates are estimated from counted values of pieces of at most
   ``PIECE`` bits of a partition (tables of a fixed size), a partition whose
   value is common gets -1 and is not probed.
3. Each fingerprint is listed under its value in every partition and probes
   all values within its threshold there. Lists and probes meet by a shuffle
   on the value; candidates are verified by their differing bits, and a task
   returns a star per component it found, never all pairs.
4. A value with more than ``hot`` rows is dealt to blocks: first all meet
   one block of the other side; after that only those rows that are not in
   the value's largest component meet all others, so that a dense ball of
   near copies costs no square.

Documents join their fingerprint's component, named by the smallest id.

Cases: null and empty texts have fingerprint zero, which links like any
other; repeated rows share theirs; a null id takes part but names no
component (null if no member has an id); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlens.llm.common import slices, split_components, words_of, written

WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
PIECE = 16  # bits of a counted piece: tables of 2^16 counts
MAX_PROBES = 4096  # of one partition
PAIR_COST = 0.01  # cost of verifying a candidate, of that of a probe
HOT = 4096  # rows of a value that are compared at once
GROUP_ROWS = 200_000  # lists and probes of a task's group, on average
PAIRS = 1 << 21  # candidates that are laid out at once

_SPREAD = np.zeros(256, np.uint64)  # the 8 bits of a byte, the lowest in the lowest of 8 lanes
for _bit in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


# --- fingerprints ----------------------------------------------------------------------------------------------
def shingle_hashes(text: str | None, n_words: int = WORDS) -> list[int]:
    words = [w.lower() for w in words_of(text)]
    joined = b" ".join(words)
    if len(words) <= n_words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-n_words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[n_words - 1:].tolist())]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """One 64-bit number per text from the hashes of its shingles."""
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    raw = np.fromiter((h for x in hashes for h in x), np.uint64, int(n.sum())).view(np.uint8).reshape(-1, 8)
    parts = -(-n[full] // 255)  # a lane of 8 bits holds 255 ones
    first = np.cumsum(n[full]) - n[full]
    start = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    of_text = np.cumsum(parts) - parts
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD.take(raw[:, k]), start).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), of_text, axis=0)
        bits = 2 * ones > n[full][:, None]
        out[full] |= np.packbits(bits, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * k)
    return out


def document_fingerprints(src: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, fp) of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints([shingle_hashes(t, n_words) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


# --- partitions ------------------------------------------------------------------------------------------------
def _bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits: 64 x 64 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1 << 16):
                x = _bits_of(b.column(0).slice(i, 1 << 16).to_numpy().view(np.uint64)).astype(np.float32)
                total += (x.T @ x).astype(np.int64)  # exact: at most 2^16 ones
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "c"])

    sums = distinct.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    out = np.zeros(BITS * BITS, np.int64)
    for r in sums.collect():  # 4096 rows
        out[r["cell"]] = r["c"]
    return out.reshape(BITS, BITS)


def widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def n_partitions(n: int, radius: int = RADIUS) -> int:
    """The number of partitions with the least cost for ``n`` fingerprints
    spread evenly, thresholds as equal as they can be."""
    def cost(m: int) -> float:
        spare = radius + 1 - m
        total = m
        for i, w in enumerate(widths(m)):
            probes = sum(comb(w, e) for e in range(spare // m + (i < spare % m) + 1))
            total += probes * (1 + PAIR_COST * n / 2 ** w)
        return total

    return min(range(2, radius + 2), key=cost)


def grouped_bits(both: np.ndarray, n: int, m: int) -> list[np.ndarray]:
    """The bits of m partitions: each starts with the free bit that is most
    correlated with the free others and takes the free bit that is most
    correlated with its own until it is full."""
    ones = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free = np.ones(BITS, bool)
    out = []
    for w in widths(m):
        own = [int(np.argmax(np.where(free, strength[:, free].sum(axis=1), -1)))]
        free[own[0]] = False
        while len(own) < w:
            nearest = int(np.argmax(np.where(free, strength[:, own].sum(axis=1), -1)))
            own.append(nearest)
            free[nearest] = False
        out.append(np.sort(np.array(own)))
    return out


def projected(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The value of a partition: its bits side by side."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits.tolist()):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def pieces(bits: np.ndarray) -> list[np.ndarray]:
    return np.array_split(bits, -(-len(bits) // PIECE))


class Plan:
    """Partitions and what the estimates need; of a size that does not depend on the data."""

    def __init__(self, partitions: list[np.ndarray], n: int, radius: int):
        self.partitions, self.n, self.radius = partitions, n, radius
        self.pieces = [p for bits in partitions for p in pieces(bits)]
        self.near: list[np.ndarray] = []  # by piece: share of fingerprints at distance 0, 1, .. from each value
        self.masks = []
        for bits in partitions:
            by_distance = []
            found = 0
            for e in range(radius + 1):
                found += comb(len(bits), e)
                if found > MAX_PROBES:
                    break
                by_distance.append(np.array([sum(1 << i for i in c) for c in combinations(range(len(bits)), e)], np.uint64))
            self.masks.append(by_distance)

    def count(self, distinct: DataFrame) -> None:
        own = self.pieces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(own), 1 << PIECE), np.int64)
            for b in batches:
                fp = b.column(0).to_numpy().view(np.uint64)
                for i, bits in enumerate(own):
                    total[i] += np.bincount(projected(fp, bits).astype(np.int64), minlength=1 << PIECE)
            cell = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "c"])

        sums = distinct.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
        table = np.zeros(len(own) << PIECE)  # at most 2^16 rows a piece
        table[sums["cell"].to_numpy()] = sums["c"].to_numpy()
        for counts, bits in zip(table.reshape(len(own), -1), own):
            near = np.zeros((self.radius + 1, 1 << len(bits)))
            near[0] = counts[:1 << len(bits)] / max(self.n, 1)
            at = np.arange(1 << len(bits))
            for k in range(len(bits)):
                near[1:] += near[:-1][:, at ^ (1 << k)]
            self.near.append(near.astype(np.float32))

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """Of each fingerprint and partition, plus 1: the cheapest with the sum radius + 1."""
        total = self.radius + 1
        best = np.full((total + 1, len(fp)), np.inf)
        best[0] = 0
        taken = []
        near = iter(self.near)
        for bits, masks in zip(self.partitions, self.masks):
            share = None
            for p in pieces(bits):
                own = next(near)[:, projected(fp, p).astype(np.int64)]
                share = own if share is None else np.stack(
                    [sum(share[d] * own[e - d] for d in range(e + 1)) for e in range(self.radius + 1)])
            cost = [np.zeros(len(fp))]
            for e, m in enumerate(masks):
                cost.append(cost[-1] + len(m) + PAIR_COST * self.n * share[e])
            following = np.full_like(best, np.inf)
            choice = np.zeros(best.shape, np.int8)
            for s in range(total + 1):
                for u in range(min(s, len(cost) - 1) + 1):
                    c = best[s - u] + cost[u]
                    better = c < following[s]
                    following[s][better] = c[better]
                    choice[s][better] = u
            best = following
            taken.append(choice)
        out = np.zeros((len(taken), len(fp)), np.int8)
        left = np.full(len(fp), total)
        for i in range(len(taken) - 1, -1, -1):
            out[i] = taken[i][left, np.arange(len(fp))]
            left = left - out[i]
        return out


def make_plan(distinct: DataFrame, n: int, radius: int = RADIUS, m: int | None = None) -> Plan:
    plan = Plan(grouped_bits(bit_counts(distinct), n, m or n_partitions(n, radius)), n, radius)
    plan.count(distinct)
    return plan


def probe_rows(distinct: DataFrame, plan: Plan) -> DataFrame:
    """(key, fp, probe): key, a partition and a value of it; probe 0, listed
    there; probe 1, asks there."""
    sent = distinct.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value

        def out(i: int, values: np.ndarray, fp: np.ndarray, probe: int) -> pa.RecordBatch:
            key = values.astype(np.int64) | np.int64(i << 40)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)),
                                               pa.array(np.full(len(fp), probe, np.int8))], names=["key", "fp", "probe"])

        for b in batches:
            for start in range(0, b.num_rows, 1 << 13):
                fp = b.column(0).slice(start, 1 << 13).to_numpy().view(np.uint64)
                reach = p.thresholds(fp)
                for i, bits in enumerate(p.partitions):
                    value = projected(fp, bits)
                    yield out(i, value, fp, 0)
                    for e, masks in enumerate(p.masks[i]):
                        asks = np.flatnonzero(reach[i] > e)
                        for s in range(0, len(masks) if len(asks) else 0, 64):
                            m = masks[s:s + 64]
                            yield out(i, (value[asks][:, None] ^ m).ravel(), np.repeat(fp[asks], len(m)), 1)

    return distinct.select("fp").mapInArrow(run, "key long, fp long, probe byte")


# --- verification ----------------------------------------------------------------------------------------------
def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n numbers reaches by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (shorter := label[label])).any():
            label = shorter
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def star_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over all listed and asking rows of equal keys with
    at most ``radius`` differing bits."""
    order = np.lexsort((probe, key))
    key, probe = key[order], probe[order]
    nodes, at = np.unique(fp[order], return_inverse=True)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    listed = np.add.reduceat((probe == 0).astype(np.int64), first) if len(key) else first
    asking = np.diff(np.append(first, len(key))) - listed
    # one line per asking row: the listed rows of its key lie side by side
    line = np.flatnonzero(probe == 1)
    owner = np.repeat(np.arange(len(first)), asking)
    size = listed[owner]
    label = np.arange(len(nodes))
    done = 0
    cum = np.cumsum(size)
    while done < len(line):
        stop = max(done + 1, int(np.searchsorted(cum, (cum[done - 1] if done else 0) + PAIRS, "right")))
        n = size[done:stop]
        a = np.repeat(at[line[done:stop]], n)
        b = at[np.repeat(first[owner[done:stop]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
        near = (a != b) & (np.bitwise_count(nodes[a] ^ nodes[b]) <= radius)
        a, b = label[a[near]], label[b[near]]
        label = least_labels(a, b, len(nodes))[label]
        done = stop
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def group_links(radius: int):
    def verify(t: pa.Table) -> pa.Table:
        key, fp, probe = (t.column(c).to_numpy() for c in ("key", "fp", "probe"))
        a, b = star_links(key, fp.astype(np.int64).view(np.uint64), probe, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return verify


def similar(distinct: DataFrame, radius: int = RADIUS, m: int | None = None, hot: int = HOT,
            group_rows: int = GROUP_ROWS) -> DataFrame:
    """(node, label): the component of every distinct ``fp`` that links with another."""
    n = distinct.count()
    rows = written(probe_rows(distinct, make_plan(distinct, n, radius, m)), "simhash-rows")
    asks = F.col("probe").cast("bigint")
    common = written(rows.groupBy("key").agg(F.sum(1 - asks).alias("n0"), F.sum(asks).alias("n1"))
                     .where((F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n0") + F.col("n1") > hot)), "simhash-common")
    schema = "a long, b long"
    groups = max(1, -(-rows.count() // group_rows))
    usual = rows.join(common.select("key"), "key", "left_anti").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    edges = written(usual.groupBy("g").applyInArrow(group_links(radius), schema).distinct(), "simhash-links")
    if not common.take(1):
        return split_components(edges)
    heavy = written(rows.join(common, "key"), "simhash-heavy")
    blocks = [F.ceil(F.col(c) / hot) for c in ("n0", "n1")]
    heavy = heavy.withColumns({"o0": blocks[0], "o1": blocks[1]})

    def place(of: str) -> F.Column:
        return F.pmod(F.xxhash64("fp"), F.col(of))

    def met(listed: DataFrame, asking: DataFrame) -> DataFrame:
        return listed.unionByName(asking).groupBy("key", "x", "y").applyInArrow(group_links(radius), schema)

    # every row meets one block of the other side
    def first_meeting(side: int) -> DataFrame:
        own, other = ("o0", "o1") if side == 0 else ("o1", "o0")
        mine, theirs = ("x", "y") if side == 0 else ("y", "x")
        zero = F.lit(0).cast("bigint")
        placed = heavy.where(F.col("probe") == side).withColumn(mine, place(own))
        partners = F.when(F.col(mine) == 0, F.sequence(zero, F.col(other) - 1)).otherwise(F.array(zero))
        return placed.withColumn(theirs, F.explode(partners)).select("key", "fp", "probe", "x", "y")

    edges = written(edges.unionByName(met(first_meeting(0), first_meeting(1))).distinct(), "simhash-links")
    # rows outside the largest component of their key meet all of the other side
    known = written(heavy.join(split_components(edges), F.col("fp") == F.col("node"), "left")
                    .withColumn("label", F.coalesce("label", "fp")).drop("node"), "simhash-known")
    by_label = known.groupBy("key", "label").count()
    largest = by_label.groupBy("key").agg(F.max(F.struct("count", "label")).alias("_l"), F.count("*").alias("labels"))
    open_ = largest.where(F.col("labels") > 1).select("key", F.col("_l.label").alias("_largest"))
    known = known.join(open_, "key").withColumn("minor", F.col("label") != F.col("_largest"))
    minor = known.where("minor").groupBy("key").agg(
        F.ceil(F.sum(1 - asks) / hot).alias("q0"), F.ceil(F.sum(asks) / hot).alias("q1"))
    known = written(known.join(minor, "key").drop("label", "_largest", "labels"), "simhash-open")

    def second_meeting(side: int) -> DataFrame:
        """Minor rows of one side, in their blocks, and all rows of the other, in theirs."""
        q, o = ("q0", "o1") if side == 0 else ("q1", "o0")
        few = (known.where((F.col("probe") == side) & F.col("minor")).withColumn("x", place(q))
               .withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(o) - 1))))
        all_ = (known.where((F.col("probe") != side) & (F.col(q) > 0)).withColumn("y", place(o))
                .withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(q) - 1))))
        cols = ["key", "fp", "probe", "x", "y"]
        return met(few.select(*cols), all_.select(*cols))

    more = second_meeting(0).unionByName(second_meeting(1))
    return split_components(written(edges.unionByName(more).distinct(), "simhash-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = written(document_fingerprints(src, n_words), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labelled = (distinct.join(similar(distinct, radius), F.col("fp") == F.col("node"), "left")
                .select("fp", "least", F.coalesce("label", "fp").alias("label")))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(labelled.join(names, "label").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")
