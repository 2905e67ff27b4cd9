"""Property tests against numpy and brute force on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from synthlens.operators import fidelity, profile, sampling, synth

SETTINGS = settings(max_examples=6, deadline=None)
values = st.lists(st.integers(min_value=-50, max_value=50).map(lambda v: v / 4), min_size=2, max_size=40)


def col(spark, xs, name="v"):
    return spark.createDataFrame([(float(x),) for x in xs], f"{name} double")


@SETTINGS
@given(p=values, q=values)
def test_histogram_counts_equal_numpy(spark, p, q):
    lo, hi = min(min(p), min(q)), max(max(p), max(q))
    got = {(r["grp"], r["bin"]): r["n"] for r in fidelity.feature_histogram(col(spark, p), col(spark, q), ["v"]).collect()}
    if hi == lo:
        assert got == {}
        return
    for grp, xs in (("p", p), ("q", q)):
        want, _ = np.histogram(np.array(xs), bins=30, range=(lo, hi))
        assert [got.get((grp, b), 0) for b in range(30)] == list(want)


@SETTINGS
@given(p=values, q=values)
def test_jsd_symmetric_and_bounded(spark, p, q):
    a = fidelity.jsd(col(spark, p), col(spark, q), ["v"]).collect()[0]["jsd"]
    b = fidelity.jsd(col(spark, q), col(spark, p), ["v"]).collect()[0]["jsd"]
    assert a == pytest.approx(b, abs=1e-5)
    assert 0.0 <= a <= np.log(2) + 5e-6  # rounded to 5 places
    assert fidelity.jsd(col(spark, p), col(spark, p), ["v"]).collect()[0]["jsd"] == 0.0


@SETTINGS
@given(xs=st.lists(st.integers(min_value=-1000, max_value=1000), min_size=1, max_size=300))
def test_exact_quantiles_equal_numpy(spark, xs):
    long_df = spark.createDataFrame([("f", float(x)) for x in xs], "feature string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    # a tiny max_rows forces the bracket refinement passes
    got = {r["prob"]: r["q"] for r in profile.exact_quantiles(long_df, ["feature"], probs, max_rows=7,
                                                                 buckets=4).collect()}
    want = np.percentile(np.array(xs, dtype=float), [p * 100 for p in probs])
    assert [got[p] for p in probs] == pytest.approx(list(want), rel=1e-12, abs=1e-9)


@SETTINGS
@given(parsed=st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=12),
       n=st.integers(min_value=1, max_value=120), b=st.integers(min_value=1, max_value=25))
def test_batch_accounting_equals_loop(spark, parsed, n, b):
    nb = -(-n // b)
    parsed = (parsed + [0] * nb)[:nb]
    total, want = 0, []
    for k in range(nb):  # the sequential rule, step by step
        req = min(b, n - total)
        if req <= 0:
            want.append((0, 0))
            continue
        acc = min(parsed[k], req)
        total += acc
        want.append((req, acc))
    df = spark.createDataFrame([(k + 1, p) for k, p in enumerate(parsed)], "batch long, parsed long")
    out = synth.batch_accounting(df, n, b).orderBy("batch").collect()
    assert [(r["requested"], r["accepted"]) for r in out] == want


def test_running_total_two_levels(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "k").selectExpr("k", "k % 7 AS v")
    out = synth.running_total(df, "k", "v", "s", block=16).orderBy("k").collect()
    assert [r["s"] for r in out] == list(np.cumsum([k % 7 for k in range(1, 1001)]))


def test_exact_sample_size_and_layout_invariance(spark):
    base = spark.range(5000).selectExpr("id", "id * 3 % 17 AS v")
    a = sampling.exact_sample(base, 100, 42).collect()
    b = sampling.exact_sample(base.repartition(13), 100, 42).collect()
    assert len(a) == 100
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert sampling.exact_sample(base.limit(40), 100, 42).count() == 40
    assert sampling.sample_sentinel(base, 0).count() == 0
    assert sampling.sample_sentinel(base, -1).count() == 5000


def test_clip_inside_bounds(spark):
    from synthlens.operators import clean

    df = spark.range(200).selectExpr("CAST(id - 100 AS DOUBLE) AS v")
    prof = spark.createDataFrame([("v", -10.0, 20.0)], "feature string, min_v double, max_v double")
    out = [r["v"] for r in clean.clip_to_profile(df, prof, ["v"]).collect()]
    assert min(out) == pytest.approx(-9.5) and max(out) == pytest.approx(21.0)


def test_vote_idempotent(spark):
    from synthlens.operators import detect

    rows = [(i, f"e{i % 5}", "ssh" if i % 3 else "non-ssh") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, endpoint string, prediction string")
    once = detect.majority_vote(df).select("id", "endpoint", "final").withColumnRenamed("final", "prediction")
    twice = detect.majority_vote(once)
    assert all(r["prediction"] == r["final"] for r in twice.collect())


def test_sample_draws_copies_by_their_share(spark, monkeypatch):
    """Repeated rows are drawn singly: a vector's share of the sample tracks
    its share of the table, also when the n-th key's range must be narrowed."""
    monkeypatch.setattr(sampling, "RANGE_ROWS", 5)
    monkeypatch.setattr(sampling, "COPY_CHUNK", 100)
    dup = spark.range(6000).selectExpr("least(id % 6, 2) AS v")  # shares 1/6, 1/6, 4/6
    out = sampling.exact_sample(dup, 1500, 7).groupBy("v").count().collect()
    got = {r["v"]: r["count"] for r in out}
    assert sum(got.values()) == 1500
    assert abs(got[0] - 250) < 60 and abs(got[1] - 250) < 60 and abs(got[2] - 1000) < 80


def test_sample_of_named_rows_counts_equal_names(spark):
    rows = spark.createDataFrame([(i % 4, i) for i in range(40)], "k long, v long")
    out = sampling.exact_sample(rows, 10, 3, key_cols=["k"])
    assert out.count() == 10 and out.distinct().count() == 10


def test_null_group_and_empty_feature(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", 5.0, None)], "g string, f double, e double")
    out = {(r["g"], r["feature"]): r for r in profile.describe_profile(df, ["f", "e"], ["g"]).collect()}
    assert out[(None, "f")]["q2"] == 2.0 and out[("a", "f")]["n"] == 1
    assert out[(None, "e")]["n"] == 0 and out[(None, "e")]["q1"] is None
    box = {r["g"]: r for r in fidelity.box_stats(df, ["f"], "g").collect()}
    assert box[None]["med"] == 2.0


def test_one_feature_calls_and_missing_bounds(spark):
    from synthlens.operators import clean

    df = spark.createDataFrame([(0.5,), (1.5,)], "f double")
    assert sorted(r["f"] for r in clean.auto_rescale(df, ["f"]).collect()) == [50.0, 150.0]
    empty = spark.createDataFrame([("f", None, None)], "feature string, min_v double, max_v double")
    with pytest.raises(Exception, match="no bounds for f"):
        clean.clip_to_profile(df, empty, ["f"]).collect()


def test_repeated_batch_counts_once(spark):
    parsed = spark.createDataFrame([(1, 20), (1, 20), (2, 20)], "batch long, parsed long")
    out = synth.batch_accounting(parsed, 60, 20).orderBy("batch").collect()
    assert [(r["batch"], r["accepted"], r["total"]) for r in out] == [(1, 20, 20), (2, 20, 40), (3, 0, 40)]


def test_vote_from_counts_equals_vote_by_rows(spark):
    from synthlens.operators import detect

    rows = [("m", 0, f"e{i % 4}" if i % 9 else detect.DUMMY_ENDPOINT, "ssh" if i % 3 else "non-ssh",
             "ssh" if i % 5 < 3 else "non-ssh") for i in range(90)]
    df = spark.createDataFrame(rows, "mode string, run int, endpoint string, truth string, prediction string")
    counts = df.groupBy(*df.columns).count().withColumnRenamed("count", "n")
    a = detect.score_from_counts(counts, ["mode"]).collect()[0]
    b = detect.confusion_counts(detect.majority_vote(df), "truth", "final", ["mode"]).collect()[0]
    assert all(a[c] == b[c] for c in ("tp", "fp", "fn", "tn"))


def test_quantiles_of_many_groups_and_a_large_one(spark, monkeypatch):
    """Small groups by a window, large ones by brackets, a few at a time; a NULL group among them."""
    monkeypatch.setattr(profile, "BRACKETS", 2)
    rng = np.random.default_rng(5)
    rows = [(None if g == 0 else f"g{g}", float(x)) for g in range(30) for x in rng.integers(0, 9, g % 7 + 1)]
    rows += [(None, float(x)) for x in rng.normal(size=400)] + [("g1", float(x)) for x in rng.normal(size=300)]
    rows += [("one", 2.5)] * 250 + [("wide", x) for x in (-1.7e308, 1.7e308) * 100]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["prob"]): r["q"] for r in
           profile.exact_quantiles(df, ["g"], [0.25, 0.5, 0.9], max_rows=50, buckets=8).collect()}
    for g in {r[0] for r in rows} - {"wide"}:
        xs = [x for k, x in rows if k == g]
        assert [got[(g, p)] for p in (0.25, 0.5, 0.9)] == pytest.approx(np.percentile(xs, [25, 50, 90]).tolist())
    assert got[("wide", 0.25)] == -1.7e308 and got[("wide", 0.9)] == 1.7e308


def test_sample_of_a_frequent_name(spark, monkeypatch):
    """One name in a third of the rows, cut into ranges: the rows and their
    numbers are those of a plain running number."""
    monkeypatch.setattr(sampling, "NAME_ROWS", 20)
    monkeypatch.setattr(sampling, "COPY_CHUNK", 7)
    rows = [(7 if i % 3 == 0 else i % 50 if i % 50 else None, i % 90) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = [tuple(r) for r in sampling.laid_out(sampling.row_counts(df, ["k"]), df.columns).collect()]
    assert sorted((k or -1, v) for k, v, _ in got) == sorted((k or -1, v) for k, v in rows)
    numbers = {}
    for k, v, c in sorted(got, key=lambda r: (r[0] or -1, r[2])):
        numbers.setdefault(k, []).append((c, v))
    for pairs in numbers.values():
        assert [c for c, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted(v for _, v in pairs)
    assert sampling.exact_sample(df, 100, 5, key_cols=["k"]).count() == 100
    assert sampling.exact_sample(df, 10_000, 5, key_cols=["k"]).count() == 900


def test_sample_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).selectExpr("id % 40 AS v").write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.read.parquet(path).mapInArrow(seen, "v long")
    assert sampling.exact_sample(df, 500, 1).count() == 500
    assert read.value == 3000


def test_hexbin_keeps_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.0, 0.0), (None, 1.0, 1.0), ("a", 2.0, 2.0)], "g string, x double, y double")
    out = fidelity.hexbin_density(df, "x", "y", "g").groupBy("g").sum("n").collect()
    assert {r["g"]: r["sum(n)"] for r in out} == {None: 2, "a": 1}


def test_missing_spec_or_bound_raises(spark):
    from synthlens.operators import clean, synth

    prof = spark.createDataFrame([(f, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0) for f in ("a", "b")],
                                 "feature string, mean double, std double, min_v double, q1 double, q2 double, q3 double, max_v double")
    specs = [synth.FeatureSpec("a", "A", "first")]
    with pytest.raises(Exception, match="no spec for the feature b"):
        synth.profile_block(prof, specs).collect()
    with pytest.raises(Exception, match="no bounds for c"):
        clean.clip_to_profile(spark.createDataFrame([(1.0,)], "c double"), prof, ["c"]).collect()


def test_several_pairs_equal_single_pairs(spark):
    """Pairs that share a group, a constant feature, NULLs and a row of no pair."""
    rng = np.random.default_rng(9)
    rows = [(g, float(x), 2.0, None if i % 5 == 0 else float(i % 9)) for i, (g, x) in
            enumerate(zip(rng.choice(list("abcd"), 400).tolist(), rng.normal(size=400).tolist()))]
    df = spark.createDataFrame(rows, "g string, u double, v double, w double")
    feats, g = ["u", "v", "w"], fidelity.F.col("g")
    both = fidelity.pairs_jsd(df, [("x", g == "a", g == "b"), ("y", g == "a", g == "c")], feats).collect()
    assert [r["feature"] for r in both] == feats
    for name, q in (("x", "b"), ("y", "c")):
        one = fidelity.pair_jsd(fidelity.pair_by_group(df, "g", "a", q, feats), feats).collect()
        assert [(r["feature"], r[name]) for r in both] == [(r["feature"], r["jsd"]) for r in one]
