"""Vector bin packing of training examples into fixed-length sequences.

An example has three demands: tokens, one segment, loss-bearing tokens (all
but a segment's first, which nothing precedes). A sequence has three
limits. Examples longer than a sequence first give whole sequences; what is
left is packed with the dot-product heuristic: the open sequence takes the
example whose demand vector has the largest weighted dot product with the
sequence's remaining capacity among those that fit all limits. If none fits
whole, the best example is cut so that the sequence is filled exactly.

Documents are dealt to groups of about ``GROUP_DOCS`` by a hash of the id and
the row's number, so equal rows spread like others; each group is packed by one task, so padding is at most one open sequence a
group (or what the segment limit forces). Token ids travel as 16-bit
numbers. Nothing is dropped: each token lies in exactly one piece.

Cases: null and empty texts have the end token only; a text longer than any
sequence is cut; repeated rows are packed as often as they occur; an empty
table gives an empty result; null ids form documents with a null id; only
the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import slices

LENGTH = 2048
MAX_SEGMENTS = 512
MAX_LOSS = 2048
END_ID = 1
GROUP_DOCS = 2048
CACHE_WORDS = 1_000_000  # pieces whose ids a worker remembers
JOINED = 1000  # new words that are encoded as one text

# a run of letters, then ASCII marks (no apostrophe: the tokenizer has rules for it)
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([.,!?;:%$&*#|()\"]+)").fullmatch

_LATIN = re.compile("[a-zß-öø-ɏ]+").fullmatch

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of whole texts. The tokenizer folds case, drops white space
    and never joins across it, nor a run of letters with the punctuation
    after it, so the ids of a text are those of its pieces in order; a worker
    encodes each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ids: dict[str, bytes] = {"": b""}
        self.closes = np.zeros(1 << 16, bool)  # by id: the last token of a word
        self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of new chunks; remembers their pieces. Words of small Latin
        letters are one word each to the tokenizer, so many are encoded as one
        text and told apart by the tokens that close a word."""
        known = self.ids
        # the small form of U+0130 ends in a combining dot, which the tokenizer joins to the marks
        split = {w: m.groups() for w in chunks if "\u0130" not in w and (m := _WORD_AND_MARKS(w))}
        new = {p for w in chunks for p in split.get(w, (w,))}.difference(known)
        plain = [p for p in new if _LATIN(p)]
        others = [p for p in new if not _LATIN(p)]
        parts = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            ends = (2 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(part):  # another kind of tokenizer
                others += part
                continue
            raw = ids.tobytes()
            known.update((p, raw[a:b]) for p, a, b in zip(part, [0, *ends], ends))
        for p, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False)):
            known[p] = array("H", e.ids).tobytes()
        return {w: known[word] + known[marks] for w, (word, marks) in split.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """16-bit ids of each text, the end token last."""
        chunks = [folded(t).replace("\n", " ").split(" ") for t in texts]
        new = {w for c in chunks for w in c}.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids = {"": b""}
            new = {w for c in chunks for w in c if w}
        made = self._learn(new) if new else {}
        known = self.ids
        end = array("H", [END_ID]).tobytes()
        return [b"".join([known[w] if w in known else made[w] for w in c]) + end for c in chunks]


def folded(text: str) -> str:
    """Lower case, as the tokenizer folds it; left to the tokenizer for the
    two letters whose folding depends on their place or changes length, and
    for text that it would compose first."""
    if text.isascii() or ("\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text)):
        return text.lower()
    return text


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack_group(lengths: np.ndarray, length: int = LENGTH, max_segments: int = MAX_SEGMENTS,
               max_loss: int = MAX_LOSS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length) for examples of the
    given token counts. Loss-bearing tokens of a piece: its length less 1."""
    sequences: list[list[tuple[int, int, int]]] = []
    full = min(length, max_loss + 1)
    for i in np.flatnonzero(lengths > full):
        sequences += [[(int(i), s, full)] for s in range(0, int(lengths[i]) - full + 1, full)]
    start = np.where(lengths > full, lengths - lengths % full, 0)
    left = lengths - start
    at = np.flatnonzero(left > 0)
    if not len(at):
        return sequences
    at = at[np.argsort(-left[at], kind="stable")]
    start, left = start[at].copy(), left[at].copy()
    caps = np.array([length, max_segments, max_loss], float)
    demand_of = lambda t: np.stack([t, np.ones_like(t), t - 1], axis=1) / caps
    demand = demand_of(left)
    weight = demand.sum(axis=0) / max(demand.sum(), 1e-9)  # scarcer limits count more
    alive = np.ones(len(at), bool)
    todo = len(at)
    room, segs, loss, pieces = length, max_segments, max_loss, []
    while todo:
        fits = alive & (left <= room) & (left - 1 <= loss) if segs else np.zeros(len(at), bool)
        value = demand @ (weight * np.array([room, segs, loss], float) / caps)
        if fits.any():
            j = int(np.argmax(np.where(fits, value, -1.0)))
            n = int(left[j])
        elif segs and min(room, loss + 1) > 0:
            j = int(np.argmax(np.where(alive, value, -1.0)))
            n = min(room, loss + 1)
        else:
            n = 0
        if n:
            pieces.append((int(at[j]), int(start[j]), n))
            room, segs, loss = room - n, segs - 1, loss - (n - 1)
            start[j] += n
            left[j] -= n
            if left[j]:
                demand[j] = demand_of(left[j:j + 1])[0]
            else:
                alive[j] = False
                todo -= 1
        if not n or not room or not segs or loss < 0:
            sequences.append(pieces)
            room, segs, loss, pieces = length, max_segments, max_loss, []
    if pieces:
        sequences.append(pieces)
    return sequences


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS,
                   group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids])."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-docs.count() // group_docs))
    id_field = T.StructField("doc_id", src.schema["doc_id"].dataType)
    coded = T.StructType([id_field, T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(enc.encode(b.column(1).to_pylist()), pa.binary())], names=coded.names)

    # the number of the row in its part spreads equal rows; a part is read from files, so a repeated task numbers it alike
    group = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.monotonically_increasing_id()),
                   F.lit(groups))
    rows = src.mapInArrow(encode, coded).withColumn("group", group)
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                     "offset")]
    out = T.StructType([id_field, *long, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])
    return rows.groupBy("group").applyInArrow(group_packer(length, max_segments, max_loss, with_ids, out.names), out)


def group_packer(length: int, max_segments: int, max_loss: int, with_ids: bool,
                 names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending")])
        ids = [np.frombuffer(x, np.uint16) for x in t.column("ids").to_pylist()]
        doc = t.column("doc_id")
        base = t.column("group")[0].as_py() << 32
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        rows: list[tuple[int, ...]] = []
        found = []
        for s, pieces in enumerate(pack_group(lengths, length, max_segments, max_loss)):
            at = 0
            for i, start, n in pieces:
                part = ids[i][start:start + n].astype("<u4")
                rows.append((i, start, n, zlib.crc32(part.tobytes()), len(ids[i]), base + s, at))
                if with_ids:
                    found.append(part.tolist())
                at += n
        cols = list(zip(*rows)) or [()] * 7
        arrays = [doc.take(pa.array(cols[0], pa.int64()))] + [pa.chunked_array([pa.array(c, pa.int64())]) for c in cols[1:]]
        if with_ids:
            arrays.append(pa.chunked_array([pa.array(found, pa.list_(pa.int64()))]))
        return pa.Table.from_arrays(arrays, names=names)

    return pack
