"""N-gram join, language-model scores, repeated substrings, the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlens.llm import lm_mix, ngram_join, suffix_dedup
from synthlens.llm.common import components, crc_mod, split_components


# --- n-gram join
def join_naive(rows, k=4, percent=85):
    sets = []
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((str(i), len(s), str(least.get(root(a)) if s else i)) for a, (i, s) in enumerate(sets))


def got_join(df, **kw):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.jaccard_join(df, **kw).collect())


def test_join_equals_all_pairs(spark, odd, odd_rows, no_docs):
    assert got_join(odd) == join_naive([(r[0], r[1]) for r in odd_rows])
    assert ngram_join.jaccard_join(no_docs).count() == 0


@pytest.mark.parametrize("limit,value", [("BLOCK", 4), ("BLOCK_TOKENS", 300)])
def test_join_of_large_groups_in_blocks(spark, monkeypatch, limit, value):
    """Near copies around the threshold, a common passage, blocks of few classes or few tokens."""
    monkeypatch.setattr(ngram_join, limit, value)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(80)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage + [f"q{i}_{j}" for j in range(rng.choice((3, 5, 8, 60)))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_join(df) == join_naive(rows)
    assert got_join(df, n_words=5, percent=80) == join_naive(rows, 5, 80)
    one = ngram_join.keep_one(df, n_words=5, percent=80)
    assert {r["doc_id"] for r in one.collect()} == {int(c) for _, _, c in join_naive(rows, 5, 80)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(-5, 70), (70, -9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {r["node"]: r["label"] for r in split_components(df).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# --- language model
def test_base_score_and_counts(documents, rows_of):
    out = lm_mix.score_texts(documents, crc_mod(F.col("doc_id"), 5) != 1, vocabulary=500).collect()
    import zlib

    train = Counter()
    for i, t, _ in rows_of:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in out}
    for i, t, _ in rows_of:
        tokens = [*(t or "").encode().lower().split(), b""]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel=1e-9)
        assert r["score"] < 0


def small_model(counts):
    code = lm_mix.make_code(sorted(counts.items(), key=lambda x: (-x[1], x[0])), sum(counts.values()) + 3)
    rng = np.random.default_rng(8)
    return lm_mix.Model(code, rng.integers(0, 256, (lm_mix.CONTEXTS, lm_mix.SLOTS), dtype=np.uint8))


def test_probabilities_of_all_next_tokens_sum_to_one():
    """Whatever the counters say, every symbol's code is a full binary tree,
    so the probabilities of all single-symbol continuations sum to one."""
    m = small_model(Counter({b"": 5, b"a": 9, b"bb": 4, b"c": 2}))
    for codes in (m.code.paths, m.code.letters):
        total = 0.0
        for path in codes:
            x = np.frombuffer(path, "<u4")
            p = 1.0
            for d in x:
                one = 0.2 + 0.6 * ((int(d) >> 1) % 97) / 97
                p *= one if d & 1 else 1 - one
            total += p
        assert total == pytest.approx(1.0)


def test_mixer_learns_and_batches_do_not_matter():
    counts = Counter({b"": 50, b"the": 90, b"of": 40, b"cat": 9})
    m = small_model(counts)
    texts = ["the cat of the cat " * 30, None, "", "unknown wörds the", "the"]
    one = [lm_mix.log10_probabilities(lm_mix.decisions([t], m.code)[0], 1, m)[0] for t in texts]
    assert one == pytest.approx(lm_mix.log10_probabilities(lm_mix.decisions(texts, m.code)[0], len(texts), m))
    bits = np.ones(40_000, np.uint8)
    cells = [np.full(len(bits), (32 << 2) + 3, np.intp)] * lm_mix.CONTEXTS
    assert -lm_mix.Mixer(lm_mix.WORD_WEIGHTS).run(cells, bits) < 0.6 * len(bits) * math.log10(2)


def test_short_texts_learn_along_the_way():
    bits = np.ones(500, np.uint8)
    cells = [np.full(len(bits), (32 << 2) + 3, np.intp)] * lm_mix.CONTEXTS
    assert -lm_mix.Mixer(lm_mix.WORD_WEIGHTS).run(cells, bits) < 0.7 * len(bits) * math.log10(2)


def test_starts_are_fitted_over_the_training_texts(documents, rows_of):
    import zlib
    from dataclasses import replace

    fold = F.xxhash64("doc_id").bitwiseAND(1).cast("int")
    learn = documents.where(crc_mod(F.col("doc_id"), 5) != 1).select("text", fold.alias("fold"))
    counts = {bytes(r["token"]): r["c"] for r in lm_mix.token_counts(learn).collect()}
    top = sorted(((t, c) for t, c in counts.items() if c > 1 or not t), key=lambda x: (x[0] != b"", -x[1], x[0]))
    m = lm_mix.gather(learn, lm_mix.make_code(top, sum(counts.values())))
    assert not np.allclose(m.starts[0].weights, lm_mix.WORD_WEIGHTS)
    assert not np.allclose(m.starts[1].weights, lm_mix.LETTER_WEIGHTS)
    held_out = [t for i, t, _ in rows_of if zlib.crc32(str(i).encode()) % 5 == 1]
    series = lm_mix.decisions(held_out, m.code)[0]
    by_hand = lm_mix.log10_probabilities(series, len(held_out), replace(m, starts=None))
    assert sum(lm_mix.log10_probabilities(series, len(held_out), m)) > sum(by_hand)


def test_every_word_met_twice_gets_a_code(spark, monkeypatch):
    class Seen(Exception):
        pass

    def make_code(top, n_all):
        raise Seen(len(top))

    monkeypatch.setattr(lm_mix, "make_code", make_code)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr(
        "concat_ws(' ', transform(sequence(id % 150 * 1000, id % 150 * 1000 + 999), x -> concat('w', x)))").alias("text"))
    with pytest.raises(Seen) as seen:
        lm_mix.score_texts(docs, F.lit(True))
    assert seen.value.args == (150_001,)


def test_codes_of_a_large_vocabulary_stay_small():
    """Some 50 bytes a word are kept, and making them takes few times as many."""
    import pickle
    import tracemalloc

    top = [(b"", 900)] + [(f"word{i}".encode(), 2 + 900_000 // (i + 1)) for i in range(100_000)]
    tracemalloc.start()
    code = lm_mix.make_code(top, 10_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    sent = pickle.loads(pickle.dumps(code))
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert peak < 200 * len(top) and kept < 60 * len(top)
    words = [b"word99999", b"", b"no such word", b"word7", b"word99999"]
    assert sent.number.of(words).tolist() == [100_000, 0, len(top), 8, 100_000]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_mix.xxhash, "xxh3_64_intdigest", lambda t: len(t))
    words = lm_mix.Words(pa.array([b"aa", b"b", b"cc", b"dd", b""], pa.large_binary()))
    assert words.of([b"dd", b"aa", b"cc", b"b", b"", b"zz", b"z", b"dd"]).tolist() == [3, 0, 2, 1, 4, 5, 5, 3]


def test_frequent_words_are_found_as_all_others(monkeypatch):
    import pyarrow as pa

    kinds = [b"", *(f"w{i}".encode() for i in range(50))]
    tokens = [*kinds[::-1], b"no", b"w3", b"none", b"w49"]
    for common in (0, 7, 1000):
        monkeypatch.setattr(lm_mix, "COMMON", common)
        words = lm_mix.Words(pa.array(kinds, pa.large_binary()))
        assert len(words.common) == min(common, len(kinds))
        assert words.of(tokens).tolist() == [*range(50, -1, -1), 51, 4, 51, 50]


def test_no_texts_have_no_decisions():
    series = lm_mix.decisions([], small_model(Counter({b"": 5, b"the": 9})).code)[0]
    assert [len(slots) for kind in series for slots in (*kind[0], kind[1])] == [0] * 2 * (lm_mix.CONTEXTS + 1)


def test_counted_cells_score_as_single_decisions(monkeypatch):
    rng = np.random.default_rng(5)
    cuts = np.array([0, 0, 5, 3000, 3033, 20_000])
    cells = [rng.integers(0, 256, cuts[-1]).astype(np.uint8) for _ in range(lm_mix.CONTEXTS)]
    bits = (rng.random(cuts[-1]) < 0.7).astype(np.uint8)
    got = []
    for least in (0, 10**9):
        monkeypatch.setattr(lm_mix, "TABLED", least)
        m = lm_mix.Mixer(lm_mix.WORD_WEIGHTS, np.linspace(-0.1, 0.1, lm_mix.MAP_GROUPS), len(cuts) - 1)
        got.append((m.run_all(cells, bits, cuts), m.weights, m.miss, m.mass))
    for a, b in zip(*got):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_passes_after_the_first_need_no_text(odd):
    docs = odd.select("doc_id", "text", (F.col("row") % 2).alias("fold"))
    counts = [(bytes(r["token"]), r["c"]) for r in lm_mix.token_counts(docs).collect()]
    code = lm_mix.make_code(sorted((x for x in counts if x[1] > 1), key=lambda x: (x[0] != b"", -x[1], x[0])), sum(c for _, c in counts))
    sent = docs.sparkSession.sparkContext.broadcast(code)
    coded = lm_mix.coded(docs, sent)
    assert "text" not in coded.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in coded.where("doc_id is not null").collect():
        tokens, number, at, _ = lm_mix.numbered([texts[r["doc_id"]]], code)
        assert np.frombuffer(r["numbers"], "<i4").tolist() == number.tolist()
        assert list(map(bytes, r["spelled"])) == [tokens[i] for i in at]
        assert r["n_bytes"] == sum(map(len, tokens)) + len(tokens)
    a, b = lm_mix.gather(coded, code, sent), lm_mix.gather(docs.select("text", "fold"), code)
    assert (a.cells == b.cells).all()
    assert np.allclose(a.starts[0].weights, b.starts[0].weights)


def test_codes_equal_those_of_a_heap():
    import heapq

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 257, 1000):
        weights = rng.integers(1, 20, n)
        heap = [(int(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above = {}
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x], above[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node))

        def path(i):
            out = []
            while i in above:
                i, branch = above[i]
                out.append(((i - n + 1) * 0x9E3779B1) & 0xFFFFFFFE | branch)
            return out[::-1]

        assert [np.frombuffer(x, "<u4").tolist() for x in lm_mix.huffman(weights)] == [path(i) for i in range(n)]


def test_large_counts_keep_their_ratio():
    import zlib

    most = (1 << 31) - 1
    tasks = [np.zeros((lm_mix.PART, 2), "<i4") for _ in range(3)]
    for i, t in enumerate(tasks):
        t[7] = (most if i else 0, most)
    out = np.frombuffer(zlib.decompress(lm_mix.summed([zlib.compress(t.tobytes()) for t in tasks])), "<i8").reshape(-1, 2)
    assert out[7].tolist() == [2 * most, 3 * most] and out.sum() == 5 * most


def test_trained_text_scores_better_than_noise(spark, odd, no_docs):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog " * 8) for i in range(20)]
                                 + [(50, "zq xj vk wq " * 26)], "doc_id long, text string")
    r = {x["doc_id"]: x["bits_per_byte"] for x in lm_mix.score_texts(docs, F.col("doc_id") < 15).collect()}
    assert r[16] < 1.0 < r[50]
    assert lm_mix.score_texts(odd, F.lit(True)).count() == 16
    assert lm_mix.score_texts(no_docs, F.lit(True)).count() == 0
    none = lm_mix.score_texts(odd, F.lit(False)).collect()
    assert all(x["n_known"] == 0 and x["train_tokens"] == 0 for x in none)


# --- repeated substrings
def repeats_naive(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        ranges = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(d), int(gone.sum()), ranges, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def texts_with_repeats():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 45, 60, 80)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60)))]
        if rng.random() < 0.8:
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [p[a:], " ".join(word() for _ in range(20))]
        texts.append("".join(parts))
    return [*texts, "a" * 700, "ab" * 300, "x" * 199, "x" * 200, passages[3], passages[3], None, "", texts[0]]


@pytest.mark.parametrize("hot", [500, 1])
def test_repeats_equal_every_window(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, n, g, f=suffix_dedup.repeated_spans: f(d, n, g, hot=hot))
    texts = texts_with_repeats()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in suffix_dedup.dedup_digest(df).collect())
    assert got == repeats_naive(texts, 200)


def test_collection_order_equals_sorted_suffixes():
    rng = random.Random(3)
    strings = [np.array([rng.randrange(1, 4) for _ in range(rng.randrange(0, 9))], np.uint16) for _ in range(30)]
    who, pos, common = suffix_dedup.suffix_order(strings, lambda s: np.ones(len(s), int))
    got = [tuple(strings[w][p:]) for w, p in zip(who, pos)]
    assert got == sorted(got) and len(got) == sum(len(s) + 1 for s in strings)
    for x, y, c in zip(got, got[1:], common[1:]):
        assert c == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_repeats_of_odd_rows(odd, odd_rows, no_docs):
    got = sorted(tuple(r)[1:] for r in suffix_dedup.dedup_digest(odd).collect())
    assert got == repeats_naive([r[1] for r in odd_rows], 200)
    clean = suffix_dedup.remove_repeats(odd)
    assert clean.columns == odd.columns and clean.count() == 16
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert suffix_dedup.dedup_digest(no_docs).count() == 0


# --- pipeline
def test_pipeline_stages(spark, documents):
    import corpus_pipeline as cp

    docs, texts = documents, {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, docs, "/root/testdata/sf0.001"), "t")
        assert docs.columns == documents.columns and 0 < docs.count()
        texts[name] = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "ngram_join":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert {i for i, _ in texts[name]} == {int(c) for _, _, c in join_naive(rows, 5, 80)}
    assert not any(n for _, n, _, _ in repeats_naive([t for _, t in texts["ngram_join"]], 200)) or texts["suffix_dedup"] != texts["ngram_join"]
    assert max(Counter(i for i, _ in texts["mixing"]).values()) <= 3
    pieces = cp.STAGES[-1][1](spark, docs, "")
    per = defaultdict(int)
    for r in pieces.collect():
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048


def test_pipeline_on_odd_rows(spark, odd, no_docs):
    import corpus_pipeline as cp

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*cols), no_docs.select(*cols)):
        for _, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, ""), "t")
        assert docs.count() >= 0
