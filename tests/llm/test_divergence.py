"""Source divergence audit against a plain count, and its term buckets."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from synthlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    """rows: (lang, source, text); the rules, term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs, total = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        for t in terms:
            count[lang, source, t] += 1
            total[lang][t] += 1
        docs[lang].update(set(terms))
    out = []
    groups = sorted({r[:2] for r in rows})
    kept = {g[0]: sorted(t for t, d in docs[g[0]].items() if d >= min_docs) for g in groups}
    apart = lambda a, b: (a - b) ** 2 // (a + b)

    def p(counts, lang):
        n, v = sum(counts), len(kept[lang])
        return [1 + 10**9 * (c + 2) // (n + 2 * v) for c in counts]

    own = {g: p([count[g[0], g[1], t] for t in kept[g[0]]], g[0]) for g in groups}
    for lang, source in groups:
        pairs = [(-sum(map(apart, own[lang, source], own[lang, s])), s) for k, s in groups if k == lang and s != source]
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
        q = p([total[lang][t] for t in kept[lang]], lang)
        terms = [(-apart(a, b), t) for t, a, b in zip(kept[lang], own[lang, source], q) if count[lang, source, t] and a > b]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("tile,block", [(64, 8192), (2, 7)])
def test_equals_plain_count(spark, documents, tile, block):
    rows = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    assert got(divergence.source_divergence(documents, tile=tile, block_terms=block)) == plain(rows, 10, 10)


def test_odd_rows(spark, odd, odd_rows, no_docs):
    rows = [(r[2], r[3], r[1]) for r in odd_rows]
    assert got(divergence.source_divergence(odd, min_docs=2)) == plain(rows, 2, 10)
    assert got(divergence.source_divergence(odd, min_docs=99)) == plain(rows, 99, 10)  # no term is kept
    assert divergence.source_divergence(no_docs).count() == 0


def test_runs_of_all_lengths(monkeypatch):
    rng = np.random.default_rng(3)
    letters = np.array(list("abABéß漢 .\n0"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(300)]
    texts += ["x" * n for n in (7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 5000)] * 2 + ["", "é" * 4, "é" * 8, "a\x00b"]
    groups = np.sort(rng.integers(0, 4, len(texts)))
    want, docs = Counter(), Counter()
    for g, t in zip(groups.tolist(), texts):
        terms = [x.translate(LOWER) for x in TERM.findall(t)]
        want.update((g, x) for x in terms)
        docs.update({(g, x) for x in terms})
    found, found_docs = Counter(), Counter()
    for terms, g, c, d in divergence.term_runs(pa.array(["skip", *texts]).slice(1), groups):
        terms.validate(full=True)
        for key in zip(g.tolist(), terms.to_pylist(), c.tolist(), d.tolist()):
            assert key[:2] not in found
            found[key[:2]], found_docs[key[:2]] = key[2:]
    assert found == want and found_docs == docs


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(10**13, 10**15 + 7, 12345)], "c long, n long, v long").select(
        divergence.share(*[divergence.F.col(x) for x in "cnv"]).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (10**15 + 7 + 2 * 12345)
