"""SimHash near-duplicates against all pairs, and the parts of the method."""

import random

import numpy as np
import pytest
import xxhash

from synthlens.llm import simhash


def plain_print(text, k=4):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_labels(prints, radius=4):
    """prints: numbers; the smallest position that each reaches."""
    x = np.array(prints, np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= radius).tolist():
            a, b = label[i], label[j]
            label[label == max(a, b)] = min(a, b)
    return label


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    label = plain_labels(prints)
    least = {}
    for (i, _), c in zip(rows, label.tolist()):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), f"{p:016x}", str(least.get(c))) for (i, _), p, c in zip(rows, prints, label.tolist()))


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_prints_equal_plain(rows_of, odd_rows):
    texts = [t for _, t, _ in rows_of] + [r[1] for r in odd_rows] + ["a b c d", "a b c d e", "É " * 700]
    found = simhash.fingerprints([simhash.shingle_hashes(t) for t in texts])
    assert found.tolist() == [plain_print(t) for t in texts]


def test_equals_all_pairs(spark, documents, rows_of, odd, odd_rows, no_docs):
    assert got(simhash.near_duplicates(documents)) == plain([(i, t) for i, t, _ in rows_of])
    assert got(simhash.near_duplicates(odd)) == plain([(r[0], r[1]) for r in odd_rows])
    assert simhash.near_duplicates(no_docs).count() == 0


def ball(rng, centre, n, most):
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))) for _ in range(n)]


def crowd(seed):
    """Balls, chains of links, prints that agree in half of their bits, lone prints."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(3):
        prints += ball(rng, rng.getrandbits(64), 120, rng.choice((3, 6, 9)))
    prints += [rng.getrandbits(32) for _ in range(150)] + [0]
    x = rng.getrandbits(64)
    for _ in range(12):
        prints.append(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    return sorted(set(prints))


@pytest.mark.parametrize("m,hot", [(None, 4096), (2, 4096), (3, 40), (4, 25), (5, 16)])
def test_components_of_prints(spark, m, hot):
    prints = crowd(m or 1)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.similar(df, m=m, hot=hot, group_rows=500).collect()}
    found = [labels.get(p, p) for p in signed]
    want = plain_labels(prints)
    assert len({*zip(found, want.tolist())}) == len(set(found)) == len(set(want.tolist()))


def test_thresholds(spark):
    """They sum up to radius - m + 1, and a common value of a partition is not probed."""
    rng = random.Random(5)
    prints = sorted({(rng.getrandbits(43) << 21) | (7 if i % 4 else rng.getrandbits(21)) for i in range(20000)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    both = simhash.bit_counts(df)
    x = np.array(prints, np.uint64)
    assert both[0, 1] == int(((x & np.uint64(3)) == 3).sum()) and both[40, 40] == int((x >> np.uint64(40) & np.uint64(1)).sum())
    plan = simhash.make_plan(df, len(prints), m=3)
    assert sorted(np.concatenate(plan.partitions).tolist()) == list(range(64))
    assert any(set(range(21)) <= set(p.tolist()) for p in plan.partitions)  # the correlated bits are together
    plan.n *= 1000  # the same shares among more prints
    reach = plan.thresholds(x).astype(int) - 1
    assert (reach.sum(axis=0) == 4 - 3 + 1).all() and reach.min() >= -1
    low = next(i for i, p in enumerate(plan.partitions) if set(range(21)) <= set(p.tolist()))
    common = (x & np.uint64((1 << 21) - 1)) == 7
    assert (reach[low][common] == -1).all() and len(np.unique(reach, axis=1).T) > 1


def test_n_partitions():
    assert simhash.n_partitions(1000) == 5
    assert simhash.n_partitions(10**9) == 3
    assert simhash.n_partitions(10**12) == 2
