"""Random forests over counted cells.

A forest splits a feature only at the edges of its at most ``max_bins`` bins,
so rows that share a label and all bins are one row to it. These rows form a
cell: a task grows its trees on the cells and their counts and then lets them
vote on the cells of the test set; each test row takes the prediction of its
cell. The cells are at most the rows, and at most ``max_bins ** features`` per
label however many rows there are. A bootstrap draws a row Poisson(1) times,
so it draws a cell of ``c`` rows Poisson(c) times: the draws have the law of a
bootstrap of the rows.

Bins come from exact counts of all rows: one pass over even ranges of each
feature, and another over each range that holds too many rows and more than
one value. Nothing depends on the layout of the tables: cells are ordered, a
tree's draws follow from its seed and number, and votes are whole numbers.

Rows do not leave the executors. The cells of one training set and of the test
set are sent to the tasks, so this module serves sets of up to ``MAX_CELLS``
cells each; ``operators.detect`` fits larger ones row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthlens.operators.joins import written

MAX_CELLS = 2_000_000  # cells of one set in a task: about 20 bytes each, and some 100 while a tree grows
TREES_PER_TASK = 10
SENT_CELLS = 500_000  # cells whose predictions (about 100 bytes each) are sent to the test rows; beyond, size decides
CHUNK = 16_384  # test cells whose votes travel in one row
FIRST_RANGES, MORE_RANGES = 1024, 32  # ranges of a feature in the first pass, and at least of a range that is cut again
HIST_CELLS = 4_000_000  # counters of the nodes that are searched for a cut at once
LARGEST = float(np.finfo(np.float64).max)
ONE = 1 << 40  # a tree's whole vote: shares of it add up alike in any order


def checked(feature: str) -> Column:
    """The feature as DOUBLE, infinity as the largest one; a row without a
    number stops the run."""
    x = F.col(feature).cast("double")
    wrong = F.raise_error(F.lit(f"{feature}: null or NaN among the features"))
    return F.when(x.isNull() | F.isnan(x), wrong).otherwise(F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)))


# ---------------------------------------------------------------- bins


def _ordered(x: float) -> int:
    """Doubles as whole numbers in the same order."""
    k = int(np.float64(x + 0.0).view(np.int64))
    return k if k >= 0 else -(k & (2**63 - 1))


def _double(k: int) -> float:
    x = float(np.int64(abs(k)).view(np.float64))
    return x if k >= 0 else -x


def _points(lo: float, hi: float, n: int) -> np.ndarray:
    """Points from ``lo`` to below ``hi``: ``n`` evenly on the line and ``n``
    evenly among the doubles between, so that a few rounds part any two, and
    the last below ``hi``, so that each end has a range of its own."""
    a, b = _ordered(lo), _ordered(hi)
    points = [lo, _double(b - 1), *(_double(a + (b - a) * i // n) for i in range(n)), *(lo * (1 - i / n) + hi * (i / n) for i in range(n))]
    points = np.unique(np.array(points) + 0.0)
    return points[(points >= lo) & (points < hi)]


def with_bins(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """``_b0, _b1, ...``: per feature the number of its cuts below the value."""
    from pyspark.ml.feature import Bucketizer

    df = df.withColumns({f"_x{i}": checked(f) for i, f in enumerate(features)})
    cut = [i for i in range(len(features)) if len(cuts[i])]
    if cut:  # its ranges are closed on the left
        splits = [[-math.inf, *np.nextafter(cuts[i], math.inf).tolist(), math.inf] for i in cut]
        df = Bucketizer(inputCols=[f"_x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut], splitsArray=splits).transform(df)
    # a feature without cuts is still looked at
    df = df.withColumns({f"_b{i}": (F.col(f"_b{i}") if i in cut else F.col(f"_x{i}").isNull()).cast("int") for i in range(len(features))})
    return df.drop(*[f"_x{i}" for i in range(len(features))])


def _counted(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> list[list]:
    """Per feature the ranges that hold rows, in order: ``(count, min, max)``."""
    binned = with_bins(df.select(*features), features, cuts)
    long = binned.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b"), checked(f).alias("x"))
                                            for i, f in enumerate(features)])))
    rows = long.groupBy("f", "b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: list[list] = [[] for _ in features]
    for r in sorted(rows, key=lambda r: (r["f"], r["b"])):
        out[r["f"]].append((r["c"], r["lo"], r["hi"]))
    return out


def _between(a: float, b: float) -> float:
    m = a / 2 + b / 2
    return m if a <= m < b else a


def _chosen_cuts(ranges: list, max_bins: int) -> np.ndarray:
    """Midpoints between all values if they are few, else between bins of
    about the same number of rows (what is left is dealt anew after each)."""
    if len(ranges) <= max_bins:
        return np.array([_between(a[2], b[1]) for a, b in zip(ranges, ranges[1:])])
    left = sum(r[0] for r in ranges)
    cuts, here = [], 0
    for before, (c, lo, _) in zip([None, *ranges], ranges):
        free = max_bins - len(cuts)
        if here and free > 1 and abs(here - left / free) < abs(here + c - left / free):
            cuts.append(_between(before[2], lo))
            left, here = left - here, 0
        here += c
    return np.array(cuts)


def bin_cuts(train: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature the values at which a tree may cut, from all rows. Few
    values have a bin each; otherwise a range with over a quarter of a bin's
    rows is cut again as long as it holds more than one value."""
    row = train.agg(F.count(F.lit(1)).alias("n"), *[g(checked(f)).alias(f"{a}{i}") for i, f in enumerate(features)
                                                    for a, g in (("lo", F.min), ("hi", F.max))]).first()
    n = row["n"]
    ranges = [[(n, row[f"lo{i}"], row[f"hi{i}"])] for i in range(len(features))] if n else [[] for _ in features]
    while True:
        again = {}
        for i, found in enumerate(ranges):
            mixed = [r for r in found if r[1] < r[2]]
            if len(found) + len(mixed) > max_bins:
                mixed = [r for r in mixed if r[0] * 4 * max_bins > n]
            if mixed:
                more = min(FIRST_RANGES, max(MORE_RANGES, 8 * FIRST_RANGES // len(mixed)))
                again[i] = np.unique(np.concatenate([[r[2] for r in found[:-1]], *[_points(r[1], r[2], more) for r in mixed]]))
        if not again:
            return [_chosen_cuts(found, max_bins) for found in ranges]
        for i, found in zip(again, _counted(train, [features[i] for i in again], list(again.values()))):
            ranges[i] = found


# ---------------------------------------------------------------- trees


def _best_cuts(x, y, w, node, counts, pick, n_bins):
    """Per open node the feature among its picked ones and the bin after which
    a cut lowers the Gini impurity most; feature -1 where none lowers it."""
    n_open, n_labels = counts.shape
    order = np.argsort(node, kind="stable")
    ends = np.searchsorted(node[order], np.arange(n_open + 1))
    feature, cut = np.full(n_open, -1, np.int32), np.zeros(n_open, np.int32)
    step = max(1, HIST_CELLS // (n_bins * n_labels))
    for a in range(0, n_open, step):
        b = min(a + step, n_open)
        rows = order[ends[a]:ends[b]]
        own, total = node[rows] - a, counts[a:b, None, :]
        base = (counts[a:b] ** 2).sum(1) / counts[a:b].sum(1) * (1 + 1e-12)
        for f in pick[a:b].T:
            at = (own * n_bins + x[rows, f[own]]) * n_labels + y[rows]
            left = np.bincount(at, w[rows], (b - a) * n_bins * n_labels).reshape(b - a, n_bins, n_labels).cumsum(1)[:, :-1]
            right = total - left
            nl, nr = left.sum(2), right.sum(2)
            score = (left ** 2).sum(2) / np.maximum(nl, 1) + (right ** 2).sum(2) / np.maximum(nr, 1)
            score[(nl == 0) | (nr == 0)] = -1
            best = score.argmax(1)
            top = score[np.arange(b - a), best]
            better = top > base
            base[better] = top[better]
            feature[a:b][better], cut[a:b][better] = f[better], best[better]
    return feature, cut


def grow_tree(x: np.ndarray, y: np.ndarray, counts: np.ndarray, n_labels: int, per_node: int, max_depth: int,
              rate: float, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree on a bootstrap of the rows in the cells: per node its feature
    (-1: a leaf), its cut, its left child (the right one follows it) and its
    shares of the labels in parts of ``ONE``."""
    w = rng.poisson(counts * rate)
    rows = np.flatnonzero(w)
    x, y, w = x[rows], y[rows], w[rows].astype(np.float64)
    n_bins = int(x.max(initial=0)) + 1
    node, m, first = np.zeros(len(rows), np.int64), 1, 0
    levels = []
    for depth in range(max_depth + 1):
        held = np.bincount(node * n_labels + y, w, m * n_labels).reshape(m, n_labels)
        share = np.rint(held / np.maximum(held.sum(1, keepdims=True), 1) * ONE).astype(np.int64)
        feature, cut, left = np.full(m, -1, np.int32), np.zeros(m, np.int32), np.zeros(m, np.int32)
        levels.append((feature, cut, left, share))
        open_ = np.flatnonzero((held > 0).sum(1) > 1)
        if depth == max_depth or n_bins == 1 or not len(open_):
            break
        number = np.full(m, -1)
        number[open_] = np.arange(len(open_))
        keep = np.flatnonzero(number[node] >= 0)
        x, y, w, node = x[keep], y[keep], w[keep], number[node[keep]]
        pick = rng.random((len(open_), x.shape[1])).argsort(1)[:, :per_node]
        f, c = _best_cuts(x, y, w, node, held[open_], pick, n_bins)
        split = np.flatnonzero(f >= 0)
        if not len(split):
            break
        feature[open_[split]], cut[open_[split]] = f[split], c[split]
        child = np.full(len(open_), -1)
        child[split] = 2 * np.arange(len(split))
        first += m
        left[open_[split]] = first + child[split]
        keep = np.flatnonzero(child[node] >= 0)
        x, y, w, node = x[keep], y[keep], w[keep], node[keep]
        node = child[node] + (x[np.arange(len(x)), f[node]] > c[node])
        m = 2 * len(split)
    return tuple(np.concatenate(part) for part in zip(*levels))


def tree_votes(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The shares of the leaf that each row of bins reaches."""
    feature, cut, left, share = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows := rows[feature[at := node[rows]] >= 0]):
        at = node[rows]
        node[rows] = left[at] + (x[rows, feature[at]] > cut[at])
    return share[node]


# ---------------------------------------------------------------- forests


def _collected(cells: DataFrame, k: int) -> tuple[np.ndarray, object]:
    """Bins and table of the cells, ordered."""
    table = cells.toArrow()
    if "_l" in table.column_names:
        table = table.sort_by([(c, "ascending") for c in ("_l", *[f"_b{i}" for i in range(k)])])
    else:
        table = table.sort_by([(f"_b{i}", "ascending") for i in range(k)])
    x = np.column_stack([table[f"_b{i}"].to_numpy() for i in range(k)]).astype(np.uint16)
    return x, table


@dataclass
class CellModel:
    """Cells of a training set; its forests follow from their seeds."""

    features: list[str]
    labels: list[str]  # the most frequent first
    cuts: list[np.ndarray]
    x: np.ndarray
    y: np.ndarray
    counts: np.ndarray


def training_cells(train: DataFrame, features: Sequence[str], label_col: str, max_bins: int) -> CellModel | None:
    """The cells of the labelled rows, or None if they are more than
    ``MAX_CELLS``."""
    train = train.where(F.col(label_col).isNotNull()).select(*features, F.col(label_col).cast("string").alias("_l"))
    cuts = bin_cuts(train, features, max_bins)
    bins = [f"_b{i}" for i in range(len(features))]
    cells = written(with_bins(train, features, cuts).groupBy(*bins, "_l").agg(F.count(F.lit(1)).alias("_n")), "forest-cells")
    if cells.count() > MAX_CELLS:
        return None
    x, table = _collected(cells, len(features))
    if not len(x):
        raise ValueError("no labelled rows to fit a forest on")
    counts = table["_n"].to_numpy().astype(np.int64)
    coded = table["_l"].combine_chunks().dictionary_encode()
    names, y = coded.dictionary.to_pylist(), coded.indices.to_numpy()  # ordered, as the cells are
    order = np.argsort(-np.bincount(y, counts, len(names)), kind="stable")
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names))
    return CellModel(list(features), [names[i] for i in order], cuts, x, rank[y], counts)


def _voting(model, test_x, seeds, num_trees, max_depth, rate) -> Callable:
    """A task's trees, grown and asked one after the other: the sums of their
    votes per chunk of the test cells."""
    per_node = max(1, math.ceil(math.sqrt(len(model.value.features))))
    groups = -(-num_trees // TREES_PER_TASK)

    def vote(batches):
        m, x = model.value, test_x.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                run, group = divmod(task, groups)
                votes = np.zeros((len(x), len(m.labels)), np.int64)
                for tree in range(group * TREES_PER_TASK, min((group + 1) * TREES_PER_TASK, num_trees)):
                    rng = np.random.default_rng([seeds[run] % 2**63, tree])
                    votes += tree_votes(grow_tree(m.x, m.y, m.counts, len(m.labels), per_node, max_depth, rate, rng), x)
                for a in range(0, len(x), CHUNK):
                    yield pa.RecordBatch.from_pydict({"_chunk": pa.array([a // CHUNK], pa.int32()), "_run": pa.array([run], pa.int32()),
                                                      "_votes": pa.array([votes[a:a + CHUNK].tobytes()], pa.binary())})

    return vote


def _deciding(test_x, n_runs, n_labels, k) -> Callable:
    """Per test cell of a chunk the label of each run, one character each
    (most votes; the more frequent label in a tie)."""

    def decide(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        x = test_x.value[chunk * CHUNK:(chunk + 1) * CHUNK]
        votes = np.zeros((n_runs, len(x), n_labels), np.int64)
        for run, part in zip(table["_run"].to_pylist(), table["_votes"].to_pylist()):
            votes[run] += np.frombuffer(part, np.int64).reshape(len(x), n_labels)
        said = (votes.argmax(2).T + FIRST_CHARACTER).astype("<u4")
        text = pa.array([row.tobytes().decode("utf-32-le") for row in np.ascontiguousarray(said)], pa.string())
        return pa.table({**{f"_b{i}": pa.array(x[:, i].astype(np.int32)) for i in range(k)}, "_said": text})

    return decide


FIRST_CHARACTER = 48  # "0" is the most frequent label, "1" the next


def said_label(labels: Sequence[str], run: int, said: str = "_said") -> Column:
    """The label that run ``run`` gave."""
    at = F.ascii(F.substring(F.col(said), run + 1, 1)) - (FIRST_CHARACTER - 1)
    return F.element_at(F.array(*[F.lit(x) for x in labels]), at)


def vote_on(model: CellModel, test: DataFrame, seeds: Sequence[int], num_trees: int, max_depth: int,
            rate: float = 1.0) -> DataFrame | None:
    """``test`` with ``_said``: what the forests of ``seeds`` say of each row,
    see ``said_label``. None if the test rows lie in over ``MAX_CELLS`` cells."""
    spark, k = test.sparkSession, len(model.features)
    bins = [f"_b{i}" for i in range(k)]
    binned = with_bins(test, model.features, model.cuts)
    cells = written(binned.select(*bins).distinct(), "forest-test-cells")
    if (n := cells.count()) > MAX_CELLS:
        return None
    sc = spark.sparkContext
    sent, test_x = sc.broadcast(model), sc.broadcast(_collected(cells, k)[0])
    tasks = len(seeds) * -(-num_trees // TREES_PER_TASK)
    votes = spark.range(0, tasks, 1, tasks).mapInArrow(_voting(sent, test_x, list(seeds), num_trees, max_depth, rate),
                                                       "_chunk int, _run int, _votes binary")
    schema = ", ".join([*[f"{b} int" for b in bins], "_said string"])
    said = votes.groupBy("_chunk").applyInArrow(_deciding(test_x, len(seeds), len(model.labels), k), schema)
    said = written(said, "forest-said")
    return binned.join(F.broadcast(said) if n <= SENT_CELLS else said, bins, "left").drop(*bins)
