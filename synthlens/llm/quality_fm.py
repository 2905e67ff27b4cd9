"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document is a sparse vector x: its words hashed to ``WORD_SLOTS`` places
(1 + log of the count, scaled to length 1) and one place per statistic for
the bin its value falls in. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

which is all pairwise interactions in time linear in the number of places.

Fitting uses a bounded sample, ``SAMPLE_ROWS`` labelled rows (the smallest
md5 keys among those the caller marks for training), featurised in tasks
and fitted by mini-batch gradient steps with a fixed seed. Scoring is one
pass over the whole table with the weights (size set by parameters, not by
data) sent to every task; no shuffle.

Cases: null text and null metadata count as empty (an empty text gets the
score of its statistics); an empty table gives an empty result; without any
labelled row every score is 0.5; null labels are not learned from; repeated
rows get equal scores. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthlens.llm.common import hex_key, slices, words_of, written

WORD_SLOTS = 1 << 15
BINS = 16
STATS = ("words", "word_length", "distinct", "capitals", "symbols", "digits", "marks", "short_words", "lines",
         "repeated_lines", "repeated_windows", "top_word", "ended_lines", "characters", "other_characters")
SIZE = WORD_SLOTS + BINS * len(STATS)
RANK = 8
SAMPLE_ROWS = 12_000
EPOCHS = 12
BATCH = 256
RATE = 0.08
DECAY = 1e-5


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x RANK

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        vx = self.factors[places] * values[:, None]
        s = vx.sum(axis=0)
        raw = self.bias + float(self.linear[places] @ values) + 0.5 * float((s * s).sum() - (vx * vx).sum())
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, raw))))


def _share_bin(part: float, whole: float) -> int:
    """Bin of a share: 0 for none, finer near zero."""
    if whole <= 0 or part <= 0:
        return 0
    return min(BINS - 1, 1 + int((BINS - 1) * math.sqrt(min(1.0, part / whole)) * 0.999))


def _size_bin(n: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, n))))


def featurise(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text and its recorded length."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    low = text.encode("utf-8").lower().split()
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = int(lengths.sum())
    windows = max(0, n - 2)
    distinct_windows = len(set(zip(words, words[1:], words[2:])))
    slots, times = np.unique(np.fromiter(map(zlib.crc32, low), np.uint32, n) % WORD_SLOTS, return_counts=True)
    bins = (
        _size_bin(n), min(BINS - 1, letters // n) if n else 0, _share_bin(len(set(low)), n),
        _share_bin(sum(map(bytes.isupper, words)), n), _share_bin(sum(map(text.count, "#*$%&|<>")), n),
        _share_bin(sum(map(text.count, "0123456789")), letters),
        _share_bin(text.count("!") + text.count("?"), n), _share_bin(int((lengths <= 3).sum()), n),
        _size_bin(len(lines)), _share_bin(len(lines) - len(set(lines)), len(lines)),
        _share_bin(windows - distinct_windows, windows), _share_bin(int(times.max()) if n else 0, n),
        _share_bin(sum(1 for x in lines if x.rstrip()[-1] in ".!?"), len(lines)),
        _size_bin(n_chars or 0), _share_bin(abs((n_chars or 0) - len(text)), max(1, len(text))),
    )
    values = (1.0 + np.log(times)).astype(np.float32)
    values /= np.sqrt((values * values).sum()) if n else 1.0
    stat = WORD_SLOTS + BINS * np.arange(len(STATS)) + np.array(bins)
    return (np.concatenate([slots.astype(np.int32), stat.astype(np.int32)]),
            np.concatenate([values, np.ones(len(STATS), np.float32)]))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 2) -> Machine:
    """Logistic loss, adaptive gradient steps over mini-batches in a seeded order."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))
    if not len(labels):
        m.factors[:] = 0
        return m
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    m.bias = math.log(share / (1 - share))
    g0, g1, g2 = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            n = np.array([len(examples[r][0]) for r in rows])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            p = np.concatenate([examples[r][0] for r in rows])
            x = np.concatenate([examples[r][1] for r in rows])
            vx = m.factors[p] * x[:, None]
            s = np.add.reduceat(vx, at, axis=0)
            raw = (m.bias + np.add.reduceat(m.linear[p] * x, at)
                   + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), at)))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]).astype(np.float32) / len(rows)
            e = np.repeat(err, n) * x
            used, back = np.unique(p, return_inverse=True)
            d1 = np.bincount(back, e, len(used)).astype(np.float32) + DECAY * m.linear[used]
            inner = e[:, None] * (np.repeat(s, n, axis=0) - vx)
            d2 = np.stack([np.bincount(back, inner[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32)
            d2 += DECAY * m.factors[used]
            g1[used] += d1 * d1
            g2[used] += d2 * d2
            m.linear[used] -= RATE * d1 / np.sqrt(g1[used])
            m.factors[used] -= RATE * d2 / np.sqrt(g2[used])
            g0 += float(err.sum()) ** 2
            m.bias -= RATE * float(err.sum()) / math.sqrt(g0)
    return m


def _featurised(df: DataFrame, carry: list[str], text_col: str, chars_col: str) -> DataFrame:
    src = df.select(*carry, F.col(text_col).cast("string").alias("_t"), F.col(chars_col).cast("bigint").alias("_n"))
    schema = T.StructType([*[src.schema[c] for c in carry], T.StructField("places", T.BinaryType()),
                           T.StructField("values", T.BinaryType())])
    k = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = [featurise(t, n) for t, n in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(k)], pa.array([p.tobytes() for p, _ in f], pa.binary()),
                 pa.array([v.tobytes() for _, v in f], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                chars_col: str = "n_chars", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most ``sample_rows`` labelled rows that satisfy ``train`` (a
    condition on the id): those of the ids that come first by a hash. Rows
    that repeat an id count too; beyond the bound they are left out in the
    order of the hash, the id and the features."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train)
             .groupBy(id_col).agg(F.max(label_col).alias("_label")))
    known = (known.withColumn("_key", hex_key(F.lit("fm"), F.col(id_col))).orderBy("_key", id_col)
             .limit(sample_rows))
    own = docs.select(F.col(id_col).alias("_id"), text_col, chars_col)
    sample = own.join(F.broadcast(known), F.col("_id") == F.col(id_col))  # at most sample_rows rows
    found = _featurised(sample.withColumn("_label", F.col("_label").cast("double")), ["_key", "_id", "_label"], text_col,
                        chars_col)
    rows = written(found.orderBy("_key", "_id", "places", "values").limit(sample_rows), "fm-sample").collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["places"])))
    return fit([(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows],
               np.array([r["_label"] for r in rows], np.float64))


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str = "n_chars") -> DataFrame:
    """(doc_id, score)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t"),
                      F.col(chars_col).cast("bigint").alias("_n"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            scores = [m.score(*featurise(t, n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
