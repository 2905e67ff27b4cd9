"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokenizer A (byte-level BPE, library ``tokenizers``) encodes a space and the
text; tokenizer B (sentencepiece with byte fallback, which puts a space in
front itself) the text. Places where tokens of both end cut the bytes into
groups; an A and a B token whose byte ranges overlap are linked.

Where a token ends is read from the tokenizers: A gives character offsets,
B the spans of its pieces (``offset_mapping``; the library no longer offers
its immutable proto, whose spans these are). They are coarse inside a
character of several bytes and at pieces of a single byte: there the end
before and the bytes of the tokens since (A's byte-level letters decoded, B's
piece or byte) place it.

Neither tokenizer joins white space to what stands before it (A's rule cuts
there; no piece of B holds white space, but for returns, after another
character), nor a sentence mark to a Latin letter before it; both are checked
against B's pieces when it is loaded. So a text is encoded by its chunks, runs
of white space with the word behind them, and the marks behind a word, and a
worker aligns each distinct chunk once.

A pair of ids counts the documents that hold it linked. Those counts are
summed by a shuffle. The most frequent ``LOOKUP`` pairs are sent to the
tasks; rarer ones are joined by a shuffle.

Cases: null and empty texts, and texts of which some token's bytes are not
those of the text (a character that B turns into a space, for one), have no
tokens: zeros and an empty digest; repeated rows are documents of their own;
null ids stay null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import slices, written

LOOKUP = 1 << 20  # pairs that are sent to the tasks, at most
CACHE_CHUNKS = 1_200_000  # distinct chunks that a worker remembers
CACHE_CHARS = 32_000_000  # and their characters
TALLY = 1 << 21  # distinct pairs that a task holds before it passes them on
JOINED = 1000  # new chunks that are encoded as one text
FIRST = " a"  # stands before them, so that none begins a text
SPACE = "▁"  # B's mark of a space

_rare_space = re.compile(r"[^\S\t-\r ]").search
_LETTER, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,!?;:]"
_chunk = re.compile(rf"[\t-\r ]*[^\t-\r ]*{_LETTER}(?={_MARKS}+(?:[\t-\f ]|\Z))|"
                    r"[\t-\r ]*[^\t-\r ]+(?:\r[\t-\r ]*[^\t-\r ]*)*|[\t-\r ]+").findall
_aligners: dict[tuple[str, str], "Aligner"] = {}


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut before each run of white space that does not
    begin with a return, and between a letter and the marks before it; a text with white space beyond ASCII's stays whole."""
    return [" " + text] if _rare_space(text) else _chunk(" " + text)


class Numbers(dict):
    """Numbers of chunks; a new one gets the next."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


def byte_letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable bytes
    stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Aligner:
    """Aligned chunks of one worker, by number."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        a_bytes = [b""] * n_a
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        single = {i for i in range(n_b) if self.b.is_byte(i)}
        if any(c in SPACE + " \t\n\v\f" for i, p in enumerate(pieces) if i not in single for c in p.lstrip(SPACE)[1:]):
            raise ValueError("a piece holds white space after another character: texts cannot be encoded by chunks")
        if any(re.search(_LETTER + _MARKS, p) for p in pieces):
            raise ValueError("a piece joins a mark to a letter: texts cannot be encoded by chunks")
        b_bytes = [bytes([int(p[3:5], 16)]) if i in single else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.n_b = n_b
        self.bytes = tuple(np.array(x, object) for x in (a_bytes, b_bytes))
        self.lengths = tuple(np.array([len(y) for y in x]) for x in (a_bytes, b_bytes))
        # an id as text before a comma, and at the end of its side of a group
        self.texts = tuple(np.array([[f"{i}{c}".encode() for c in ("," + last)] for i in range(n)], object)
                           for n, last in ((n_a, "|"), (n_b, ";")))
        self.key = np.uint32 if n_a * n_b < 1 << 32 else np.uint64
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.groups: list[bytes | None] = []  # each with a semicolon behind; None: the bytes differ
        self.sizes: list[bytes] = []  # n_a, n_b, n_groups
        self.pairs: list[bytes] = []  # linked pairs of the chunk, repeats included
        self.chars = 0

    def numbers(self, parts: list[list[str]]) -> list[list[int]]:
        """Numbers of the chunks of each text; new ones are aligned, many at
        once: side by side they are a text of their own."""
        if len(self.number) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self.forget()
        get = self.number.__getitem__
        out = [list(map(get, p)) for p in parts]
        new, self.number.new = self.number.new, []
        start = 0
        for i, c in enumerate(new):
            # what does not begin with white space, or ends with it, or holds rare ones, has no neighbours
            alone = not c[0].isspace() or c[-1].isspace() or _rare_space(c) is not None
            if alone or i - start == JOINED:
                if i > start:
                    self.learn(new[start:i])
                start = i
            if alone:
                self.learn([c])
                start = i + 1
        if start < len(new):
            self.learn(new[start:])
        return out

    def learn(self, chunks: list[str]) -> None:
        text = FIRST + "".join(chunks)
        encoded = self.a.encode(text, add_special_tokens=False)
        spans = self.b.encode([text[1:]], return_type="offset_mapping", return_bytes=True, num_threads=1)[0]
        a, b = np.array(encoded.ids, np.int64), np.array(spans["ids"], np.int64)
        raw = text.encode()
        if any(b"".join(known[x].tolist()) != raw for known, x in zip(self.bytes, (a, b))):
            if len(chunks) > 1:
                for half in (chunks[:len(chunks) // 2], chunks[len(chunks) // 2:]):
                    self.learn(half)
            else:
                self._keep(chunks, [None], [b""], [b""])
            return
        ends_a = self.a_ends(text, a, np.array(encoded.offsets, np.int64).reshape(-1, 2))
        ends_b = self.b_ends(b, np.array(spans["offsets"], np.int64).reshape(-1, 2))
        cuts = np.cumsum([len(FIRST), *[len(c.encode()) for c in chunks]])
        # between two ends of any tokens lies the overlap of just one pair
        ends = np.union1d(ends_a, ends_b)
        keys = a[np.searchsorted(ends_a, ends)] * self.n_b + b[np.searchsorted(ends_b, ends)]
        both = np.intersect1d(ends_a, ends_b)
        sides = []
        for ids, own, texts in ((a, ends_a, self.texts[0]), (b, ends_b, self.texts[1])):
            group = np.searchsorted(both, own)
            sides.append((group, texts[ids, (both[group] == own).astype(np.int64)]))
        order = np.argsort(np.concatenate([2 * sides[0][0], 2 * sides[1][0] + 1]), kind="stable")
        shown = np.concatenate([sides[0][1], sides[1][1]])[order].tolist()
        at = [np.searchsorted(x, cuts, "right") for x in (ends_a, ends_b, both, ends)]
        sizes = np.stack([np.diff(x) for x in at[:3]], axis=1).astype(np.uint32).tobytes()
        tokens, pairs, width = (at[0] + at[1]).tolist(), at[3].tolist(), np.dtype(self.key).itemsize
        raw_keys = keys.astype(self.key).tobytes()
        self._keep(chunks, [b"".join(shown[s:e]) for s, e in zip(tokens, tokens[1:])],
                   [sizes[i:i + 12] for i in range(0, len(sizes), 12)],
                   [raw_keys[s * width:e * width] for s, e in zip(pairs, pairs[1:])])

    def _keep(self, chunks: list[str], groups: list[bytes | None], sizes: list[bytes], pairs: list[bytes]) -> None:
        self.groups += groups
        self.sizes += sizes
        self.pairs += pairs
        self.chars += sum(map(len, chunks))

    def a_ends(self, text: str, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where each token ends in the text's bytes: at the end of its last
        character, if the next token does not share it."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        place = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        sure = np.append(offsets[1:, 0] >= offsets[:-1, 1], True)
        return refined(place[offsets[:, 1]], sure, self.lengths[0][ids])

    def b_ends(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Likewise; the space in front is not in the spans, and of a
        character's bytes only the last has a span."""
        return refined(offsets[:, 1] + 1, offsets[:, 1] > offsets[:, 0], self.lengths[1][ids])


def refined(coarse: np.ndarray, sure: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The coarse ends where they are sure; elsewhere the last sure one and
    the bytes of the tokens since then."""
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    from_ = np.where(last >= 0, coarse[last] - total[last], 0)
    return np.where(sure, coarse, from_ + total)


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def align_texts(texts: list[str], al: Aligner):
    """Of each text: (n_a, n_b, n_groups, n_links), the digest, and the
    distinct pairs with their times, as bytes."""
    numbers = al.numbers([chunks_of(t) if t else [] for t in texts])
    out = []
    for own in numbers:
        groups = [al.groups[i] for i in own]
        if not own or None in groups:
            out.append(((0, 0, 0, 0), "", b"", b""))
            continue
        sizes = np.frombuffer(b"".join([al.sizes[i] for i in own]), np.uint32).reshape(-1, 3).sum(axis=0, dtype=np.int64)
        key = np.frombuffer(b"".join([al.pairs[i] for i in own]), al.key)
        n_links = len(key)
        key, times = np.unique(key, return_counts=True)
        out.append(((*sizes.tolist(), n_links), hashlib.sha256(b"".join(groups)[:-1]).hexdigest(), key.tobytes(),
                    times.astype("<u4").tobytes()))
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(k), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return k, total


def pair_counts(rows: DataFrame, dtype: type) -> DataFrame:
    """(pair, n): documents that hold the pair linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, distinct = [], [], 0, 0

        def out() -> pa.RecordBatch:
            k, c = _merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], names=["pair", "n"])

        for b in batches:
            own = [np.frombuffer(x, dtype) for x in b.column(0).to_pylist()]
            k, c = np.unique(np.concatenate([np.zeros(0, dtype), *own]), return_counts=True)  # a document holds a pair once
            keys.append(k)
            counts.append(c)
            fresh += len(k)
            if fresh > max(TALLY, distinct):
                k, c = _merged(keys, counts)
                keys, counts, fresh, distinct = [k], [c], 0, len(k)
                if distinct > TALLY:
                    yield out()
                    keys, counts, distinct = [], [], 0
        if keys:
            yield out()

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                    lookup: int = LOOKUP) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()),
                           T.StructField("times", T.BinaryType())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for b in slices(batches):
            out = align_texts(b.column(1).to_pylist(), al)
            sizes, digests, pairs, times = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in (zip(*sizes) if sizes else [()] * 4)], pa.array(digests, pa.string()),
                 pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], names=schema.names)

    rows = src.mapInArrow(align, schema).withColumn("rid", F.monotonically_increasing_id())
    rows = written(rows, "align-rows")  # written once, so the row numbers hold
    al = aligner(a_path, b_path)
    dtype, n_b = al.key, al.n_b
    counts = written(pair_counts(rows, dtype), "align-counts")
    of_a = F.expr(f"pair div {n_b}L")
    highest = counts.groupBy(of_a.alias("_a")).agg(F.max("n").alias("_most"))  # a row per id of A
    counts = written(counts.withColumn("_a", of_a).join(highest, "_a")
                     .select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "align-best")
    # the lowest power of two above which at most `lookup` pairs lie
    level = F.floor(F.log2("n")).cast("int").alias("level")
    size = {r["level"]: r["c"] for r in counts.groupBy(level).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
    least, held = 63, 0
    while least > 0 and held + size.get(least - 1, 0) <= lookup:
        least -= 1
        held += size.get(least, 0)
    frequent = counts.where(F.col("n") >= F.lit(1 << least)).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast((frequent["pair"].to_numpy(), frequent["n"].to_numpy(),
                                         frequent["best"].to_numpy()))
    out = T.StructType([*[f for f in rows.schema if f.name not in ("pairs", "times")],
                        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()),
                                                                        T.StructField("times", T.LongType())])))])
    given = [f.name for f in out][:-3]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in slices(batches):
            keys = [np.frombuffer(x, dtype) for x in b.column(b.schema.get_field_index("pairs")).to_pylist()]
            times = [np.frombuffer(x, "<u4") for x in b.column(b.schema.get_field_index("times")).to_pylist()]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            k = np.concatenate([np.zeros(0, dtype), *keys]).astype(np.int64)
            t = np.concatenate([np.zeros(0, "<u4"), *times]).astype(np.int64)
            at = np.searchsorted(pair, k)
            at[at == len(pair)] = 0
            known = pair[at] == k if len(pair) else np.zeros(len(k), bool)
            o, x, w = owner[known], at[known], t[known]
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            np.add.at(sums[0], o, w * best[x])
            np.add.at(sums[1], o, w * n[x])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=len(keys)))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(k[~known]), pa.array(t[~known])], names=["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in given],
                                              pa.array(sums[0]), pa.array(sums[1]), rare], names=out.names)

    found = rows.mapInArrow(look_up, out)
    if least > 0:
        found = written(found, "align-found")
        rest = found.select("rid", F.inline("rare")).join(counts.where(F.col("n") < F.lit(1 << least)), "pair")
        rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_b"),
                                       F.sum(F.col("times") * F.col("n")).alias("_s"))
        found = (found.drop("rare").join(rest, "rid", "left")
                 .withColumns({"n_best": F.col("n_best") + F.coalesce("_b", F.lit(0)),
                               "count_sum": F.col("count_sum") + F.coalesce("_s", F.lit(0))}))
    return found.select("doc_id", *names, "n_best", "count_sum", "groups_sha256")
