"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased) and one end token. Every token is a
series of binary decisions:

- a word among all training tokens met at least twice (and the end token)
  is one symbol of a Huffman code over those tokens;
- any other word is the code of an escape symbol, then its bytes and a stop
  mark, each in a Huffman code over bytes.

Every decision is predicted by three counters, found by hashing a context
with the decision's place in its code: for words the place alone, the
previous word, and the previous word's ending; for bytes the two bytes
before, the four bytes before, and the word so far. All texts are coded
once, as the numbers of their tokens; counters are gathered
from all training texts (``SLOTS`` pairs of counts per context, summed over
tasks). A logistic mixer adds the counters' stretched probabilities with
weights from a set chosen (gated) by how often the counters were seen; a
last stage refines the result by a map from predicted to observed rates.
Each text starts from weights and a map fitted over all training texts (see
``fitted``) and learns from its own decisions as it goes, in blocks that
double from ``FIRST_BLOCK`` decisions. The score is the sum of the decisions' log10
probabilities, the total bits per byte of the word bytes its other form.

The base score is that of single tokens with additive smoothing. Frequent
tokens are sent to the tasks (those of the code, which grow with the data);
all others are counted by a shuffle join.

Cases: null and empty texts are the end token alone; repeated rows score
alike; without training text every decision starts even; an empty table
gives an empty result; a null id counts as the text ``null`` in the fold
rule. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import slices, written

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  # counters per context
CONTEXTS = 3
PART = 1 << 15  # slots per shuffled row
FLUSH = 200_000  # distinct tokens that a task holds before it passes them on
TEXTS = 400  # texts whose decisions are laid out at once
COMMON = 1 << 16  # words (the first, so the most frequent) that are found in a dict
FIRST_BLOCK = 32
RATE = 0.02
TALLY = 1 << 21  # distinct keys that a task holds before it passes them on
ROUNDS = 8  # of the fit, at most
HOLD = 50.0  # how firmly the fit holds on to the hand-set weights
STOP = 256  # the mark after a spelled word
END = b""  # the end token; no word is empty

_U = np.uint32
_NONE = np.ones(1, np.uint32)


# --- token counts ----------------------------------------------------------------------------------------------
def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of (text): counted in tasks, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              names=["token", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens_of(t))
                held[END] += 1
                if len(held) > FLUSH:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


# --- codes -----------------------------------------------------------------------------------------------------
@dataclass
class Tree:
    """A code as its tree: the node above each (leaves first; the root is its
    own) and the branch from there. A symbol's decisions are 32-bit numbers:
    the node where one is taken, spread over the upper 31 bits, and the
    branch in the lowest. They are laid out when the symbol is met."""

    above: np.ndarray
    branch: np.ndarray

    def __len__(self) -> int:
        return (len(self.above) + 1) // 2

    def __getitem__(self, i: int) -> bytes:
        if i >= len(self):
            raise IndexError(i)
        return self.laid_out(np.array([i]))[1].astype("<u4").tobytes()

    def laid_out(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of decisions of each symbol, and all decisions in a row."""
        depth = np.zeros(len(symbols), np.int64)
        levels = []
        node = symbols
        while (inner := node != len(self.above) - 1).any():
            up = self.above[node]
            place = (up - (len(self) - 1)).astype(np.uint32) * _U(0x9E3779B1) & _U(0xFFFFFFFE)
            levels.append(place | self.branch[node])
            depth += inner
            node = up
        if not levels:
            return depth, np.zeros(0, np.uint32)
        return depth, np.stack(levels[::-1], axis=1)[np.arange(len(levels)) >= len(levels) - depth[:, None]]


def huffman(weights: np.ndarray) -> Tree:
    """The lightest two are joined again and again, of equals the one with the
    lower number: symbols by weight and joined nodes as they come are two
    queues that are in order by themselves."""
    n = len(weights)
    weights = np.asarray(weights).astype(np.int64)
    order = np.argsort(weights, kind="stable")
    symbols, light = array("q", order.tobytes()), array("q", weights[order].tobytes())
    joined = array("q")
    pairs = (array("i"), array("i"))
    i = j = 0
    for _ in range(n - 1):
        total = 0
        for side in pairs:
            if i < n and (j >= len(joined) or light[i] <= joined[j]):
                total += light[i]
                side.append(symbols[i])
                i += 1
            else:
                total += joined[j]
                side.append(n + j)
                j += 1
        joined.append(total)
    tree = Tree(np.arange(2 * n - 1, dtype=np.int32), np.zeros(2 * n - 1, np.uint8))
    for branch, side in enumerate(pairs):
        tree.above[np.array(side, np.int64)] = np.arange(n, 2 * n - 1)
        tree.branch[np.array(side, np.int64)] = branch
    return tree


class Words:
    """Numbers of distinct words, kept as one Arrow array: the first by a dict,
    the others looked up by sorted hashes and compared in full."""

    def __init__(self, words: pa.Array):
        self.words = words
        h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in _each(words)), np.uint64, len(words))
        order = np.argsort(h, kind="stable")
        self.hashes, self.order = h[order], order.astype(np.int32)
        again = self.order[1:][self.hashes[1:] == self.hashes[:-1]]  # as good as never
        self.twins = {self.words[int(i)].as_py(): int(i) for i in again}

    def __len__(self) -> int:
        return len(self.words)

    @cached_property
    def common(self) -> dict[bytes, int]:
        """Some 7 MB, whatever the data; only where words are looked up."""
        return {t: i for i, t in enumerate(self.words.slice(0, COMMON).to_pylist())}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """The number of each token; of one that is no word, how many words there are."""
        number = np.fromiter(map(self.common.get, tokens, repeat(-1)), np.int64, len(tokens))
        others = np.flatnonzero(number < 0)
        number[others] = self._looked_up([tokens[i] for i in others.tolist()])
        return number

    def _looked_up(self, tokens: list[bytes]) -> np.ndarray:
        place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        kinds = list(place)
        number = np.full(len(kinds), len(self), np.int64)
        if kinds and len(self):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
            found = self.order[at]
            same = pc.equal(self.words.take(pa.array(found)), pa.array(kinds, self.words.type))
            number = np.where(same.to_numpy(zero_copy_only=False), found, number)
            for t in self.twins.keys() & place.keys():
                number[place[t]] = self.twins[t]
        return number[np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))]


def _each(words: pa.Array) -> Iterator[bytes]:
    """The words, few at a time as Python objects."""
    for i in range(0, len(words), 1 << 16):
        yield from words.slice(i, 1 << 16).to_pylist()


@dataclass
class Code:
    """Numbers of the vocabulary words (the end token among them), the
    decisions of each and of the escape (last), the hashes of each word and
    of its ending, and the decisions of the bytes and the stop mark. All are
    arrays: some 50 bytes a word in all."""

    number: Words
    paths: Tree
    whole: np.ndarray
    ending: np.ndarray
    letters: Tree

    def __getstate__(self) -> bytes:
        """Packed, as each executor keeps what is sent to it on disk."""
        return zlib.compress(pickle.dumps((self.number.words, self.paths, self.whole, self.ending, self.letters), 5), 1)

    def __setstate__(self, state: bytes) -> None:
        words, self.paths, self.whole, self.ending, self.letters = pickle.loads(zlib.decompress(state))
        self.number = Words(words)


def make_code(top: pa.Table | list[tuple[bytes, int]], n_all: int) -> Code:
    """From the most frequent tokens and the number of all training tokens."""
    if not isinstance(top, pa.Table):
        top = pa.table({"token": pa.array([t for t, _ in top], pa.binary()), "c": pa.array([c for _, c in top], pa.int64())})
    words = pa.concat_arrays([*top["token"].cast(pa.large_binary()).chunks, pa.array([], pa.large_binary())])
    counts = top["c"].to_numpy()
    logs = np.fromiter(map(math.log1p, counts), float, len(counts))
    letters = np.ones(257)
    for i in range(0, len(words), 1 << 16):  # spelled words are rare words, but letters are shared
        part = words.slice(i, 1 << 16).to_pylist()
        np.add.at(letters, np.frombuffer(b"".join(part), np.uint8), np.repeat(logs[i:i + len(part)], [len(t) for t in part]))
    letters[STOP] += sum(map(float, logs))
    if not pc.any(pc.equal(pc.binary_length(words), 0)).as_py():
        words = pa.concat_arrays([words, pa.array([END], words.type)])
        counts = np.append(counts, 1)
    escape = max(1, n_all - int(counts.sum()))
    paths = huffman(np.append(counts, escape) + 1)
    whole = np.fromiter(map(zlib.crc32, _each(words)), np.uint32, len(words))
    ending = np.fromiter((zlib.crc32(t[-2:]) for t in _each(words)), np.uint32, len(words))
    return Code(Words(words), paths, whole, ending, huffman(np.ceil(letters)))


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([zlib.crc32(t) for t in words], np.uint32), np.array([zlib.crc32(t[-2:]) for t in words], np.uint32))


def _laid_out(code: Tree, symbols: np.ndarray):
    """The number of decisions of each symbol of a series, then the place and
    the branch of each decision."""
    kinds, own = (np.arange(257), symbols) if len(code) == 257 else np.unique(symbols, return_inverse=True)
    depth, decided = code.laid_out(kinds)
    n = depth[own]
    first = (np.cumsum(depth) - depth)[own] - (np.cumsum(n) - n)
    at = np.repeat(first, n)
    at += np.arange(len(at))
    x = decided.take(at)
    return n, x >> _U(1), (x & _U(1)).astype(np.uint8)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _U(0x85EBCA6B)
    x = (x ^ (x >> _U(13))) * _U(0xC2B2AE35)
    return x ^ (x >> _U(16))


def _slots(context: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Slots of the ``n`` decisions under each context: the high bits of a product."""
    x = np.repeat(context, n)
    x += place
    x *= _U(0x85EBCA6B)
    x >>= _U(32 - SLOT_BITS)
    return x


def _cuts(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First decision of each text from the decisions of its symbols."""
    return np.concatenate([[0], np.cumsum(n)])[first]


def numbered(texts: list[str | None], code: Code) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the texts of a batch, their numbers, the places of the
    spelled ones, and the first token of each text."""
    tokens: list[bytes] = []
    starts = [0]
    for t in texts:
        tokens += tokens_of(t)
        tokens.append(END)
        starts.append(len(tokens))
    number = code.number.of(tokens)
    return tokens, number, np.flatnonzero(number == len(code.number)), np.array(starts)


def decisions(texts: list[str | None], code: Code):
    """For the texts of a batch, the decisions as ``decided`` has them, and
    what ``numbered`` has."""
    tokens, number, at, first = numbered(texts, code)
    return decided(number, [tokens[i] for i in at.tolist()], first, code), tokens, number, at, first


def decided(number: np.ndarray, spelled: list[bytes], first: np.ndarray, code: Code):
    """From the numbers of all tokens of a batch, its spelled words and the
    first token of each text, the decisions over words, then those over the
    letters of spelled words: two tuples (slots: one array per context, bits,
    start of each text). Every decision of a text is in one of them."""
    at = np.flatnonzero(number == len(code.number))
    previous, last = (np.concatenate([h, _NONE]).take(number) for h in (code.whole, code.ending))
    previous[at], last[at] = _word_hashes(spelled)
    previous, last = (np.concatenate([_NONE, h])[:len(number)] for h in (previous, last))
    previous[first[:-1]] = last[first[:-1]] = 1
    n, place, bit = _laid_out(code.paths, number)
    words = ([place >> _U(31 - SLOT_BITS), _slots(_hash(previous, 1), n, place), _slots(_hash(last, 2), n, place)],
             bit, _cuts(n, first))
    size = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    raw = np.full(int(size.sum()), STOP, np.int64)
    start = np.cumsum(size) - size
    nth = np.arange(len(raw)) - np.repeat(start, size)
    raw[nth < np.repeat(size, size) - 1] = np.frombuffer(b"".join(spelled), np.uint8)
    shifted = np.concatenate([np.full(4, 257), raw]).astype(np.uint32)
    before = [np.where(nth >= k, shifted[4 - k:4 - k + len(raw)], _U(257)) for k in (1, 2, 3, 4)]
    two = before[0] * _U(258) + before[1]
    four = two * _U(258 * 258) + before[2] * _U(258) + before[3]
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max(initial=1)), _U(0x01000193))]), dtype=np.uint32)
    sums = np.concatenate([_NONE - _NONE, np.cumsum(_hash(raw.astype(np.uint32), 5) * powers[nth], dtype=np.uint32)])
    so_far = sums[:-1] - np.repeat(sums[start] if len(start) else sums[:0], size)
    n, place, bit = _laid_out(code.letters, raw)
    letter_starts = np.concatenate([start, [len(raw)]])[np.searchsorted(at, first)]
    letters = ([_slots(_hash(x, k), n, place) for k, x in ((6, two), (7, four), (8, so_far))], bit, _cuts(n, letter_starts))
    return words, letters


# --- coded texts -----------------------------------------------------------------------------------------------
def coded(docs: DataFrame, sent: Broadcast[Code]) -> DataFrame:
    """The rows of (text, other columns) with each text as the numbers of its
    tokens (32 bits each), its spelled words and its bytes, a separator after
    each word: written once, as every later pass needs them."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("numbers", T.BinaryType()),
                           T.StructField("spelled", T.ArrayType(T.BinaryType())), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for b in slices(batches, TEXTS):
            if not b.num_rows:
                continue
            tokens, number, at, first = numbered(b.column(len(rest)).to_pylist(), code)
            flat = number.astype("<i4").tobytes()
            n_bytes = np.add.reduceat(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, first[:-1])
            spelled = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()),
                                               pa.array([tokens[i] for i in at.tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(rest)], pa.array([flat[4 * x:4 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
                 spelled, pa.array(n_bytes)], names=schema.names)

    return written(docs.select(*rest, "text").mapInArrow(run, schema), "lm-coded")


def read_back(numbers: pa.Array, spelled: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The numbers of all tokens of some rows of ``coded``, their spelled
    words, and the first token of each text."""
    flat = numbers.to_pylist()
    number = np.frombuffer(b"".join(flat), "<i4").astype(np.int64)
    return number, spelled.flatten().to_pylist(), np.cumsum([0, *(len(x) // 4 for x in flat)])


# --- counters --------------------------------------------------------------------------------------------------
def summed(parts: list[bytes]) -> bytes:
    """A part's counts (64 bits, so neither branch is cut short) from those of the tasks (32 bits)."""
    out = np.zeros(PART * 2, np.int64)
    for x in parts:
        out += np.frombuffer(zlib.decompress(x), "<i4")
    return zlib.compress(out.astype("<i8").tobytes(), 1)


def counter_rows(docs: DataFrame, sent: Broadcast[Code]) -> DataFrame:
    """(part, counts): the counters of all (coded) training texts, summed over tasks
    part by part (a part: PART slots of one context)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        held = np.zeros((CONTEXTS, 2 * SLOTS), np.int32)
        for b in slices(batches, TEXTS):
            for slots, bits, _ in decided(*read_back(b.column(0), b.column(1)), c):
                for k in range(CONTEXTS):
                    np.add.at(held[k], (slots[k] << _U(1) | bits).astype(np.intp), np.int32(1))
        parts = held.reshape(-1, PART * 2)
        for p in range(len(parts)):
            if parts[p].any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()),
                                                  pa.array([zlib.compress(parts[p].astype("<i4").tobytes(), 1)], pa.binary())],
                                                 names=["part", "counts"])

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"part": t.column("part").slice(0, 1), "counts": pa.array([summed(t.column("counts").to_pylist())], pa.binary())})

    schema = "part int, counts binary"
    return docs.select("numbers", "spelled").mapInArrow(run, schema).groupBy("part").applyInArrow(total, schema)


@dataclass
class Start:
    """What every text's decisions of one kind start from."""

    weights: np.ndarray  # CONTEXTS x 4, by gate
    shift: np.ndarray  # of the refining map, by group


@dataclass
class Model:
    code: Code
    cells: np.ndarray  # CONTEXTS x SLOTS: 6 bits of stretched probability, 2 bits of how often it was seen
    starts: tuple[Start, Start] | None = None  # of words and of letters; none: as set by hand


def gathered(docs: DataFrame, sent: Broadcast[Code]) -> np.ndarray:
    """The counters: SLOTS x CONTEXTS pairs reach the driver, whatever the data."""
    out = np.zeros((CONTEXTS * SLOTS // PART, PART, 2), np.int64)
    for r in counter_rows(docs, sent).toLocalIterator():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8").reshape(PART, 2)
    return out


def cells_of(counts: np.ndarray) -> np.ndarray:
    cells = np.empty(counts.shape[:2], np.uint8)
    for part, n in zip(cells, counts):
        stretch = np.clip(np.rint(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)) * 4) + 32, 0, 63).astype(np.uint8)
        part[:] = stretch << 2 | np.digitize(n.sum(axis=1), SEEN).astype(np.uint8)
    return cells.reshape(CONTEXTS, SLOTS)


def gather(docs: DataFrame, code: Code, sent: Broadcast[Code] | None = None) -> Model:
    """The model of (text, fold): counters of all texts, and the start fitted
    on each fold's texts under the counters of the other fold alone, as the
    counters of a text's own decisions would foretell them. ``sent``: the
    code, if it was sent to the tasks before (the texts may be coded, too)."""
    sent = sent or docs.sparkSession.sparkContext.broadcast(code)
    docs = coded(docs, sent) if "text" in docs.columns else docs
    folds = [gathered(docs.where(F.col("fold") == f), sent) for f in (0, 1)]
    starts = fitted(docs, sent, [cells_of(folds[1]), cells_of(folds[0])])
    return Model(code, cells_of(folds[0] + folds[1]), starts)


# --- starts ----------------------------------------------------------------------------------------------------
def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def joint_counts(docs: DataFrame, sent: Broadcast[Code], others: list[np.ndarray]) -> DataFrame:
    """(part, keys, counts): how often each triple of cells met each branch,
    by kind, over all coded texts and their folds; exact, so that the rounds of the
    fit need not read the texts again. ``others``: by fold, the cells to use."""
    sent_cells = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cells = sent.value, sent_cells.value
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        fresh = distinct = 0

        def out() -> pa.RecordBatch:
            k, n = merged(keys, counts)
            parts = k >> _U(17)
            firsts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            spans = list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(k)]))
            return pa.RecordBatch.from_arrays(
                [pa.array(parts[firsts].astype(np.int32)), pa.array([zlib.compress(k[a:b].tobytes(), 1) for a, b in spans], pa.binary()),
                 pa.array([zlib.compress(n[a:b].tobytes(), 1) for a, b in spans], pa.binary())], names=["part", "keys", "counts"])

        for b in slices(batches, TEXTS):
            fold = b.column(2).to_numpy(zero_copy_only=False)
            for f in (0, 1):
                own = b.filter(pa.array(fold == f))
                for kind, (slots, bits, _) in enumerate(decided(*read_back(own.column(0), own.column(1)), c)):
                    key = np.full(len(bits), kind, np.uint32)
                    for k in range(CONTEXTS):
                        key = key << _U(8) | cells[f][k].take(slots[k])
                    key = key << _U(1) | bits
                    key.sort()
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    keys.append(key[first])
                    counts.append(np.diff(np.append(first, len(key))))
                    fresh += len(first)
            if fresh > max(TALLY, distinct):
                k, n = merged(keys, counts)
                keys, counts, fresh, distinct = [k], [n], 0, len(k)
                if distinct > TALLY:
                    yield out()
                    keys, counts, distinct = [], [], 0
        if sum(map(len, keys)):
            yield out()

    def total(t: pa.Table) -> pa.Table:
        k, n = merged(*([np.frombuffer(zlib.decompress(x.as_py()), d) for x in t.column(name)] for name, d in (("keys", "<u4"), ("counts", "<i8"))))
        return pa.table({"part": t.column("part").slice(0, 1), "keys": pa.array([zlib.compress(k.tobytes(), 1)], pa.binary()),
                         "counts": pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())})

    schema = "part int, keys binary, counts binary"
    return docs.select("numbers", "spelled", "fold").mapInArrow(run, schema).groupBy("part").applyInArrow(total, schema)


def fitted(docs: DataFrame, sent: Broadcast[Code], others: list[np.ndarray]) -> tuple[Start, Start]:
    """Weights that make the training texts likeliest, by Newton rounds over
    the joint counts (gradients and second derivatives summed per task), and
    the map's shifts under them."""
    joint = written(joint_counts(docs, sent, others), "lm-joint")
    weights = np.stack([WORD_WEIGHTS, LETTER_WEIGHTS])
    held = weights.copy()
    for rounds in range(ROUNDS + 1):
        slope, bend, miss, mass = _sums(joint, weights)
        if rounds == ROUNDS:
            break
        pull = slope - HOLD * (weights - held).reshape(2, -1)
        step = np.stack([np.linalg.solve(bend[i] + HOLD * np.eye(bend.shape[1]), pull[i]) for i in (0, 1)]).clip(-1, 1)
        if np.abs(step).max() < 1e-3:
            break
        weights = weights + step.reshape(weights.shape)
    return tuple(Start(weights[i], miss[i] / (mass[i] + MAP_MASS)) for i in (0, 1))


def _sums(joint: DataFrame, weights: np.ndarray) -> list[np.ndarray]:
    """By kind: first and second derivatives of the log likelihood, and by
    group of the map the branches beyond those foretold and the decisions."""
    n = CONTEXTS * 4
    shapes = ((2, n), (2, n, n), (2, MAP_GROUPS), (2, MAP_GROUPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend, miss, mass = map(np.zeros, shapes)
        for b in batches:
            for keys, counts in zip(b.column(1), b.column(2)):
                key = np.frombuffer(zlib.decompress(keys.as_py()), "<u4")
                c = np.frombuffer(zlib.decompress(counts.as_py()), "<i8").astype(float)
                kind = int(key[0] >> _U(25))  # a part holds one kind
                own = [(key >> _U(17 - 8 * k)) & _U(255) for k in range(CONTEXTS)]
                s = [STRETCH[x] for x in own]
                place = [GATE[x] + 4 * k for k, x in enumerate(own)]
                z = sum(weights[kind].ravel()[i] * x for i, x in zip(place, s))
                p = 1 / (1 + np.exp(-np.clip(z, -8, 8)))
                err, spread = c * ((key & _U(1)) - p), c * p * (1 - p)
                group = _GROUP[((np.clip(z, -8, 8) + 8) * MAP_SCALE + 0.5).astype(np.intp)]
                miss[kind] += np.bincount(group, err, MAP_GROUPS)
                mass[kind] += np.bincount(group, c, MAP_GROUPS)
                for i in range(CONTEXTS):
                    slope[kind] += np.bincount(place[i], err * s[i], n)
                    for j in range(CONTEXTS):
                        bend[kind] += np.bincount(place[i] * n + place[j], spread * s[i] * s[j], n * n).reshape(n, n)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in (slope, bend, miss, mass)])],
                                                   pa.list_(pa.float64()))], names=["sums"])

    rows = joint.mapInArrow(run, "sums array<double>").collect()
    flat = np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(sum(map(math.prod, shapes)))
    return [x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum([math.prod(x) for x in shapes])[:-1]), shapes)]


# --- scores ----------------------------------------------------------------------------------------------------
SEEN = (0.5, 4.5, 64.5)  # a counter was seen never, a few times, often, very often
STRETCH = ((np.arange(256) >> 2) - 32) / 4.0  # of a cell
GATE = np.arange(256) & 3  # of a cell: which weight of its context
# Weights by gate, for each context of words and of letters: where the fit starts.
WORD_WEIGHTS = np.array([[0, 0.8, 1.0, 1.0], [0, 0.15, 0.5, 0.5], [0, 0.15, 0.5, 0.5]])
LETTER_WEIGHTS = np.array([[0, 0.3, 0.4, 0.4], [0, 0.3, 0.4, 0.4], [0, 0.3, 0.4, 0.4]])
MAP_SCALE = 32  # cells of the refining map per unit of stretched probability
MAP_CELLS = 16 * MAP_SCALE + 1
_MIXED = 1 / (1 + np.exp(-(np.arange(MAP_CELLS) / MAP_SCALE - 8)))
_GROUP = np.arange(MAP_CELLS) // (MAP_SCALE // 2)  # the refining map learns one shift per half unit
MAP_GROUPS = int(_GROUP[-1]) + 1
_FIRST = np.searchsorted(_GROUP, np.arange(MAP_GROUPS))
_ERR = (np.array([0, 1]) - _MIXED[:, None]).ravel()  # of a cell and a branch
TABLED = 2 * MAP_CELLS  # decisions a text from which a block's cells are counted
MAP_MASS = 40.0  # decisions that a starting shift counts for


class Mixer:
    """Weights and refining map of decisions of one kind, for each text of a
    batch; the texts go through their blocks side by side."""

    def __init__(self, weights: np.ndarray, shift: np.ndarray | None = None, n_texts: int = 1):
        self.weights = np.repeat(weights[None], n_texts, axis=0)
        self.miss = np.repeat(MAP_MASS * (np.zeros(MAP_GROUPS) if shift is None else shift)[None], n_texts, axis=0)
        self.mass = np.full((n_texts, MAP_GROUPS), MAP_MASS)

    def run(self, cells: list[np.ndarray], bits: np.ndarray) -> float:
        """Sum of log10 probabilities of one text; learns after each block."""
        return float(self.run_all(cells, bits, np.array([0, len(bits)]))[0])

    def run_all(self, cells: list[np.ndarray], bits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The sum of each text, whose decisions lie between two cuts."""
        sizes = np.diff(cuts)
        totals = np.zeros(len(sizes))
        start, block = 0, FIRST_BLOCK
        series = np.stack([*cells, bits]).astype(np.uint8, copy=False)
        room = np.empty((CONTEXTS, len(bits)), np.intp)
        while len(texts := np.flatnonzero(sizes > start)):
            n = np.minimum(sizes[texts] - start, block)
            at = cuts[texts] + start
            part = np.concatenate([series[:, x:y] for x, y in zip(at.tolist(), (at + n).tolist())], axis=1)
            ids, bit = np.arange(len(texts)), part[CONTEXTS]
            row = np.repeat(ids << 8, n)
            own = [np.add(row, c, out=x[:len(row)]) for c, x in zip(part, room)]
            scaled = (self.weights[texts][:, :, GATE] * (STRETCH * MAP_SCALE)).astype(np.float32)
            mixed = scaled[:, 0].ravel().take(own[0])
            for k in range(1, CONTEXTS):
                mixed += scaled[:, k].ravel().take(own[k])
            mixed += 8 * MAP_SCALE + 0.5
            np.maximum(mixed, 0, out=mixed)
            np.minimum(mixed, MAP_CELLS - 1, out=mixed)
            cell = mixed.astype(np.intp)
            shift = self.miss[texts] / self.mass[texts]
            if len(row) < TABLED * len(texts):
                foretold = _MIXED.take(cell)
                group = np.repeat(ids * MAP_GROUPS, n)
                group += _GROUP.take(cell)
                refined = foretold + shift.ravel().take(group)
                np.maximum(refined, 1e-4, out=refined)
                np.minimum(refined, 1 - 1e-4, out=refined)
                totals[texts] += np.bincount(np.repeat(ids, n), np.log(np.abs((1 - bit) - refined).astype(np.float32)), len(texts))
                err = bit - foretold
                miss = np.bincount(group, err, MAP_GROUPS * len(texts)).reshape(-1, MAP_GROUPS)
                mass = np.bincount(group, minlength=MAP_GROUPS * len(texts)).reshape(-1, MAP_GROUPS)
            else:  # the same by how often each cell met each branch
                cell <<= 1
                cell |= bit
                err = _ERR.take(cell)
                cell += np.repeat(ids * (2 * MAP_CELLS), n)
                met = np.bincount(cell, minlength=2 * MAP_CELLS * len(texts)).reshape(-1, MAP_CELLS, 2)
                refined = np.clip(_MIXED + shift[:, _GROUP], 1e-4, 1 - 1e-4)
                totals[texts] += (met * np.log(np.stack([1 - refined, refined], axis=2).astype(np.float32))).sum(axis=(1, 2))
                miss = np.add.reduceat((met * _ERR.reshape(-1, 2)).sum(axis=2), _FIRST, axis=1)
                mass = np.add.reduceat(met.sum(axis=2), _FIRST, axis=1)
            rate = (RATE / np.sqrt(n))[:, None]
            for k in range(CONTEXTS):
                slope = np.bincount(own[k], err, 256 * len(texts)).reshape(-1, 256) * STRETCH
                self.weights[texts, k] += rate * slope.reshape(-1, 64, 4).sum(axis=1)  # the gate is a cell's lowest bits
            self.miss[texts] += miss
            self.mass[texts] += mass
            start, block = start + block, block * 2
        return totals / math.log(10)


def log10_probabilities(series, n_texts: int, m: Model) -> list[float]:
    """The model's log10 probability of each text, from the batch's decisions."""
    totals = np.zeros(n_texts)
    starts = m.starts or (Start(WORD_WEIGHTS, np.zeros(MAP_GROUPS)), Start(LETTER_WEIGHTS, np.zeros(MAP_GROUPS)))
    for (slots, bits, cuts), start in zip(series, starts):
        cells = [m.cells[k].take(slots[k]) for k in range(CONTEXTS)]
        totals += Mixer(start.weights, start.shift, n_texts).run_all(cells, bits, np.asarray(cuts))
    return totals.tolist()


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None, vocabulary: int | None = None) -> DataFrame:
    """(doc_id, carried columns, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte). ``train``: condition on the id. ``vocabulary``: at
    most so many words get a code (none: all met at least twice)."""
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("_train"),
                       *[c.alias(k) for k, c in carry.items()])
    counts = written(token_counts(rows.where("_train")), "token-counts")
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(all_["n"]), int(all_["v"])
    # words met once are spelled, which teaches the escape and the letters what new words cost
    first = counts.where((F.col("c") > 1) | (F.length("token") == 0)).orderBy(F.length("token") > 0, F.desc("c"), "token")
    top = (first if vocabulary is None else first.limit(vocabulary)).toArrow()
    spark = docs.sparkSession
    code = make_code(top, n)
    sent_code = spark.sparkContext.broadcast(code)
    texts = coded(rows.withColumn("fold", F.xxhash64("doc_id", "text").bitwiseAND(1).cast("int")), sent_code)
    model = gather(texts.where("_train"), code, sent_code)
    floor = n + 0.5 * (v + 1)
    # by number; the end token comes first, and is unknown only if nothing was learned
    unknown = int(not len(top))
    count = np.append(top["c"].to_numpy(), np.zeros(len(code.number) - len(top)))
    known = spark.sparkContext.broadcast(np.append(np.log10((count + 0.5) / floor), 0.0))
    sent = spark.sparkContext.broadcast((model.cells, model.starts))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(k, rows.schema[k].dataType) for k in carry],
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_top", T.LongType()),
                           T.StructField("top_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("rare", T.ArrayType(T.BinaryType()))])
    k = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(sent_code.value, *sent.value)
        base = known.value
        for b in slices(batches, TEXTS):
            if not b.num_rows:
                continue
            n_bytes, spelled = b.column(k), b.column(k + 1)
            number, rare, first = read_back(b.column(k + 2), spelled)
            scores = log10_probabilities(decided(number, rare, first, m.code), b.num_rows, m)
            n_tokens = np.diff(first)
            n_rare = pc.list_value_length(spelled).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], pa.array(n_tokens), pa.array(n_tokens - n_rare - unknown),
                 pa.array(np.add.reduceat(base.take(number), first[:-1])), pa.array(scores, pa.float64()), n_bytes, spelled],
                names=schema.names)

    scored = (texts.select("doc_id", *carry, "n_bytes", "spelled", "numbers").mapInArrow(run, schema)
              .withColumn("rid", F.monotonically_increasing_id()))
    scored = written(scored, "lm-scores")  # written once, so the row numbers hold
    rare = scored.select("rid", F.explode("rare").alias("token"))
    found = (rare.join(counts, "token", "left").groupBy("rid")
             .agg(F.count("c").alias("n_more"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))).alias("more")))
    out = scored.drop("rare").join(found, "rid", "left")
    return out.select("doc_id", *carry, "n_tokens", (F.col("n_top") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
                      F.lit(n).cast("bigint").alias("train_tokens"),
                      (F.col("top_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
                      (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
