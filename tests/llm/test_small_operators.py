"""Sharding, quality classifier, URL filters, quality rules, mixing, exact top-k, packing."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlens.llm import mixing, packing, quality_fm, quality_rules, sharding, url_filter, va_topk
from synthlens.llm.common import crc_mod
from synthlens.llm.queries import ORACLE_SQL, QUERIES, SHARDS, URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert norm(got.select(*cols).collect()) == norm(res.fetchall())


# --- sharding
def naive_table(shards, size):
    owner, order = [-1] * size, {}
    for s in shards:
        a, b = sharding._number("start", s) % size, sharding._number("step", s) % (size - 1) + 1
        order[s] = [(a + j * b) % size for j in range(size)]
    filled, turn = 0, 0
    while filled < size:
        s = shards[turn % len(shards)]
        slot = next(x for x in order[s] if owner[x] < 0)
        owner[slot] = turn % len(shards)
        filled, turn = filled + 1, turn + 1
    return owner


def test_lookup_table_equals_naive_fill():
    shards = tuple(f"s{i}" for i in range(7))
    assert list(sharding.lookup_table(shards, 101)) == naive_table(shards, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_table_is_even_and_stable():
    full, fewer = sharding.lookup_table(SHARDS), sharding.lookup_table(SHARDS[:-1])
    n = Counter(full.tolist())
    assert max(n.values()) - min(n.values()) <= 1
    moved = ((full != fewer) & (full != len(SHARDS) - 1)).mean()
    assert moved < 0.05
    half = Counter(sharding.lookup_table(("a", "b"), 101, (2, 1)).tolist())
    assert half[0] > 1.8 * half[1]


def test_shards_of_odd_rows(odd, no_docs):
    rows = sharding.assign_shards(odd, "doc_id", ("a", "b", "c"), 101).collect()
    assert len(rows) == 16 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    owner = naive_table(("a", "b", "c"), 101)
    assert all(owner[r["slot"]] == r["shard_index"] for r in rows)
    assert sharding.assign_shards(no_docs, "doc_id", ("a", "b")).count() == 0


# --- quality classifier
def test_scores_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op2_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [r for r in out.collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, 4)) * 0.1)
    p, x = np.array([3, 9, 40]), np.array([0.5, 1.0, 0.2])
    raw = 0.3 + m.linear[p] @ x + sum(m.factors[p[i]] @ m.factors[p[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.score(p, x) == pytest.approx(1 / (1 + math.exp(-raw)))


def test_classifier_on_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, 1), (12, 0), (5, None), (None, 1), (7, 0)], "doc_id long, quality int")
    m = quality_fm.fit_quality(odd, labels, crc_mod(F.col("doc_id"), 4) >= 0)
    rows = quality_fm.score_quality(odd, m).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality_fm.fit_quality(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_fm.score_quality(odd, none).collect()} == {0.5}
    assert quality_fm.score_quality(no_docs, m).count() == 0


def test_classifier_fits_on_no_more_than_its_bound(spark, monkeypatch):
    docs = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.concat_ws(" ", F.lit("word"), F.col("id") % 50).alias("text"), F.lit(8).alias("n_chars"))
    sizes, first = [], []
    fit = quality_fm.fit

    def seen(rows, y):
        sizes.append(len(rows))
        first.append([r[0].tobytes() for r in rows])
        return fit(rows, y)

    monkeypatch.setattr(quality_fm, "fit", seen)
    for d in (docs.where("doc_id = 7"), docs, docs.repartition(7), docs.where("doc_id > 4990")):
        labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
        quality_fm.fit_quality(d, labels, F.lit(True), sample_rows=10)
    assert sizes == [10, 10, 10, 9]
    assert first[1] == first[2]  # the same rows on any layout


# --- URL filters
def judge_naive(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


def test_url_rules_against_every_rule(spark):
    rules = [*URL_RULES, ("a.b.c.d.example.org", "/x", "block"), ("b.c.d.example.org", "/", "allow"), ("example.org", "/es/", "allow"),
             ("exam-ple.org", "/", "block"), ("net", "/", "block"), ("net", "/deep/er", "allow"), ("", "/", "block")]
    rules = [r for r in rules if r[0]]
    hosts = ["org", "example.org", "EXAMPLE.org", "www.example.org", "z.a.b.c.d.example.org", "a.b.c.d.example.org",
             "notexample.org", "exam-ple.org", "x.com", "com", "q.net", "", "..net", "b.c.d.example.org"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?x=1", "/fr/", "/de/#a", "/x/y", "/deep/er/1", "?a=/es/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "nohost", "a://", "://x.com/de/", "x://y://com/de/"]
    urls += urls[:3]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, verdict string")
    rdf = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rdf).collect()}
    assert got == {i: judge_naive(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), rdf).count() == 0
    plain = url_filter.judge_urls(pages, rdf.limit(0)).collect()
    assert len(plain) == len(urls) and all(r["rule"] is None and r["verdict"] == "allow" for r in plain)


def test_url_query_gives_the_contracts_verdicts(spark, tmp_path):
    want = {"https://a.org/": ("org/", "allow"), "https://example.org/es/x": ("example.org/es/", "block"),
            "https://www.example.org/en/12": ("example.org/en/1", "block"), "https://example.org/en/2": ("org/", "allow"),
            "https://x.com/fr/": ("com/fr/", "allow"), "https://x.com/de/y": ("com/de/", "block"),
            "https://x.com/it/": (None, "allow")}
    rows = [(i, u, "h", "v") for i, u in enumerate(want)]
    spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op4_url_filters"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


# --- quality rules
def test_rules_on_odd_rows(odd, no_docs):
    rows = quality_rules.quality_counts(odd).collect()
    assert len(rows) == 16
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["n_words"] == by[5]["n_words"] == by[6]["n_words"] == 0 and by[4]["base_failed"]
    assert by[1]["kept"] and not by[12]["kept"]
    kept = quality_rules.clean_documents(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 13} <= {r["doc_id"] for r in kept.collect()}
    assert quality_rules.clean_documents(no_docs).count() == 0


def test_lines_go_and_documents_that_lose_too_much():
    good = " ".join(f"w{i}" for i in range(70)) + "."
    more = " ".join(f"v{i}" for i in range(30)) + "."
    counts, base, kept, text = quality_rules.judge(f"Home | About | Contact\n{good}\nAll rights reserved.\n{more}\nmenu")
    assert kept and not base and text == f"{good}\n{more}" and counts[5] == 3
    assert quality_rules.judge(good + "\n" + "MANY WORDS IN CAPITALS HERE " * 20)[2] is False


def test_prose_that_mentions_boilerplate_is_kept():
    prose = " ".join(f"w{i}" for i in range(70))
    for phrase in [p.decode() for p in quality_rules.BOILERPLATE]:
        for text in (f"{prose} {phrase} and more.", f"{prose}.\nThey told us about the words {phrase} in a short line."):
            counts, base, kept, left = quality_rules.judge(text)
            assert kept and not base and left == text and counts[5] == 0
        for line in (phrase.capitalize() + ".", f"{phrase.upper()} | {phrase}", f"Acme 2024 {phrase}"):
            assert quality_rules.judge(f"{prose}.\n{line}")[3] == f"{prose}."
    assert quality_rules.judge(f"{prose}.\nDesign in Tokyo.")[3] == f"{prose}.\nDesign in Tokyo."


# --- mixing
def test_mix_reaches_targets(documents, no_docs, odd):
    rows = mixing.mix_sources(documents).collect()
    per = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in rows:
        p = per[r["source"]]
        p[0], p[1], p[2], p[3] = p[0] + r["taken"], r["target"], r["source_size"], max(p[3], r["size"])
        assert r["taken"] in [k * r["size"] for k in range(4)]
    for taken, target, size, largest in per.values():
        assert abs(taken - target) <= largest / 2 + 1 and target <= 3 * size
    assert sum(p[1] for p in per.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = mixing.mix_sources(documents.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mix_sources(no_docs).count() == 0
    out = mixing.mix_sources(odd, carry=odd.columns).collect()
    assert len(out) == 16 and all(r["taken"] == r["copies"] * r["size"] for r in out)


# --- exact top-k
def test_topk_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(300)]
    rows += [(i, rows[0][1], "x") for i in range(300, 360)]  # a group of equal vectors
    rows += [(400, None, "x"), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (600, [float("nan")] * 6, "x"), (700, [1.0], "x"), (800, [], "x"),
             (900, [float("inf")] * 6, "x"), (None, rows[0][1], "x"), rows[5], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in va_topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()]
    v = {i: [math.floor(1024 * x) for x in e] for i, e, _ in rows[:360]}
    want = []
    for q in (0, 100, 200, 300):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:10]
        want += [(q, k, c, -x) for k, (x, c) in enumerate(s, 1)]
    assert sorted(got) == sorted(want)
    few = va_topk.top_k(df.where("vec_id < 4"), F.col("vec_id") % 100 == 0, 10).collect()
    assert len(few) == 3
    assert va_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_topk_with_few_bounds_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = va_topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()
    monkeypatch.setattr(va_topk, "BOUNDS_AT_ONCE", 64)  # seven vectors for nine queries
    got = va_topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(got) == sorted(want) and len(got) == 90


# --- packing
def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = Counter(tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts)
    seqs, found = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        found[(r["doc_id"], r["doc_tokens"])].append((r["start"], tuple(r["ids"])))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    assert sum(len(i) for x in found.values() for _, i in x) == sum(len(k) * c for k, c in want.items())
    return seqs, found, want


def test_packing_round_trip(documents, rows_of):
    rows = packing.pack_documents(documents, tokenizer_path(), with_ids=True).collect()
    seqs, found, want = check_pieces(rows, [t for _, t, _ in rows_of])
    assert Counter(tuple(x for _, ids in sorted(p) for x in ids) for p in found.values()) == want
    used = sum(n for s in seqs.values() for _, n in s)
    assert used / (len(seqs) * packing.LENGTH) > 0.98


def test_packing_odd_rows(odd, odd_rows, no_docs):
    rows = packing.pack_documents(odd, tokenizer_path(), group_docs=5, with_ids=True).collect()
    check_pieces(rows, [r[1] for r in odd_rows])
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_all_limits_hold():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 900, 300)
    for length, segments, loss in ((512, 4, 500), (512, 100, 300), (64, 3, 64)):
        out = packing.pack_group(lengths, length, segments, loss)
        got = np.zeros(300, int)
        for s in out:
            assert sum(n for _, _, n in s) <= length and len(s) <= segments and sum(n - 1 for _, _, n in s) <= loss
            for i, _, n in s:
                got[i] += n
        assert (got == lengths).all()


def test_encoder_equals_tokenizer_on_odd_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    texts = ["ΣΑΣ σας", "İstanbul", "e\u0301 É", "it's we'll 'S don'T", "<|endoftext|> x", "3.14 $5!! \x1c \x85\ta\r\nc", "ß ẞ ﬁ",
             "日本語 テスト。", "x_y __ a-b --", "A\u030a", "", "  ", "İ.", "BEYLİ.", "ADANALİ, X", "İİ!? i̇."]
    rng = np.random.default_rng(4)
    letters = np.array(list("aIİißΣσéE\u0301\u0307ǅªⅧ²ñ日ﬁ.,!?;()'-_ 1"))
    texts += ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(6000)]
    got = packing.encoder(tokenizer_path()).encode(texts)
    assert [list(np.frombuffer(g, np.uint16)) for g in got] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_equal_rows_are_spread_over_groups(spark):
    df = spark.createDataFrame([(1, "one two three.")] * 600, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(df, tokenizer_path(), group_docs=50).collect()
    assert len(out) == 600 and len({r["sequence_id"] >> 32 for r in out}) == 12


def test_rules_twin_on_mentions_and_notices(spark, tmp_path):
    """The SQL twin where a line mentions a phrase, is one, or holds several side by side."""
    import duckdb

    from synthlens.llm.queries import ORACLE_SQL

    prose = " ".join(f"word{i}" for i in range(70))
    lines = ["All rights reserved.", "privacy policy terms of use", "Privacy Policy | Terms of Service | x y", "see our privacy policy",
             "read the privacy policy before you write to us again", "designed in to it", "xclick here now", "click hereé", "click here click here a b c d"]
    rows = [(i, f"{prose}\n{x}\n{prose} {x} {prose}") for i, x in enumerate(lines)] + [(90, prose + " privacy policy " + prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    names = sorted(quality_rules.quality_counts(df).columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op5_quality_rules']})").fetchall()
    got = [tuple(r) for r in quality_rules.quality_counts(df).select(*names).collect()]
    assert sorted(got) == sorted(want) and len({r[names.index("n_lines_removed")] for r in got}) > 1
