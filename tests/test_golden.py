"""Golden micro-cases (FIXTURES.md part C)."""

import json
import math

import pytest
from pyspark.sql import functions as F

from synthlens.operators import clean, detect, features, fidelity, profile, synth

FENCE = "```"

# (reply, parsed items, kept records) -- features a and b unless noted
REPLIES = [
    ('[{"a":1,"b":1},{"a":2,"b":2}]', 2, 2),
    (FENCE + 'json\n[{"a":1,"b":1}]\n' + FENCE, 1, 1),
    (FENCE + '[{"a":1,"b":1}]' + FENCE, 1, 1),
    ('Sure: [{"a":1,"b":1}] done', 1, 1),
    ('[{"a":1,"b":2},{"a":3,"b":4},{"a":5', 2, 2),
    ('[{"a":1,"b":2},{"a":3,"b":4},{"a":5,"b":', 2, 2),
    ('[{"a":1,"b":2},{"a":12345', 1, 1),
    ('[{"a":1,"b":1},{"a":2,"b":1},{"a":3]', 2, 2),
    (FENCE + 'json\n[{"a":1,"b":2},{"a":12345\n' + FENCE, 1, 1),
    ('Sure: [{"a":1,"b":2},{"a":12345', 0, 0),
    ('{"a":1,"b":1}', 0, 0),
    ('{"x":[{"a":1,"b":1}]}', 1, 1),
    ("[1,2]", 2, 0),
    ("[]", 0, 0),
    ("", 0, 0),
    ("no json", 0, 0),
    ("] x [", 0, 0),
    ('[{"a":1,"b":1}] and [2]', 0, 0),
    ('[{"a":1,"b":1},]', 0, 0),
    ('[{"a":NaN,"b":1},{"a":Infinity,"b":1}]', 2, 0),
    ('[{"a":"7.5","b":1}]', 1, 0),
    ('[{"a":1},{"b":2}]', 2, 0),
]


def test_reply_parser_goldens(spark):
    replies = spark.createDataFrame([(i + 1, r) for i, (r, _, _) in enumerate(REPLIES)], "batch long, response string")
    counts = {r["batch"]: r["parsed"] for r in synth.parsed_counts(replies).collect()}
    recs = synth.records_from_replies(replies, ["a", "b"])
    kept = {r["batch"]: r["n"] for r in clean.drop_incomplete(recs, ["a", "b"]).groupBy("batch")
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, (text, parsed, keep) in enumerate(REPLIES):
        assert counts[i + 1] == parsed, text
        assert kept.get(i + 1, 0) == keep, text


def test_reply_parser_agrees_with_the_json_reader(spark):
    """Items of odd texts against Python's reader of the same candidate."""
    texts = ['[{"a":1}]}', '[{"a":1}],"z":[1]', '[1],"end":1,"x":[2]', '[{"a":1}],"r":[{"a":2}]', "[{'a':1}]", '[{"a":01}]',
             '[{"a":.5}]', '[{"a":5.}]', '[{"a":1 /*c*/}]', '[{"a":1},,{"a":2}]', '[{"a":1e400}]', '[{"a":-Infinity,"b":2}]',
             '[{"a":true,"b":1}]', '[{"a":1},[{"a":2}],null,"x",3]', '[{"a":1,"a":2}]', '[ {"a" : 1.5E3 } ]', '[[1]] x [2]',
             '[{"a":"x\ty"}]', '[{"a":{"c":1},"b":4}]', '[{"a":123456789012345678901234567890}]']

    def number(v):
        ok = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
        return float(v) if ok else None

    def items(text):
        return [(number(x.get("a")), number(x.get("b"))) if isinstance(x, dict) else (None, None) for x in json.loads(text)]

    def read(text):
        candidate = text[text.index("["):text.rindex("]") + 1]
        cut = candidate.rfind(",", 0, len(candidate) - 5)
        for t in [candidate] + ([candidate[:cut] + "]"] if cut > 0 else []):
            try:
                return items(t)
            except ValueError:
                continue
        return []

    texts = [(i, text, read(text)) for i, text in enumerate(texts)]
    replies = spark.createDataFrame([(i, t) for i, t, _ in texts], "batch long, response string")
    got = {}
    for r in synth.records_from_replies(replies, ["a", "b"]).orderBy("batch", "pos").collect():
        got.setdefault(r["batch"], []).append((r["a"], r["b"]))
    for i, text, want in texts:
        assert got.get(i, []) == want, text


def test_failed_calls_say_why(spark):
    def completer(system, prompt):
        if prompt == "p1":
            raise ValueError("too long")
        return None if prompt == "p2" else "[]"

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "batch long, prompt string")
    out = {r["batch"]: (r["response"], r["error"]) for r in synth.completion_source(prompts, completer=completer).collect()}
    assert out == {0: ("[]", None), 1: (None, "ValueError: too long"), 2: (None, synth.NO_REPLY)}


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("p,q,expected", [
    ([1, 2, 3, 4], [1, 2, 3, 4], 0.0),
    ([0, 0, 0, 0], [1, 1, 1, 1], 0.69315),
    ([1, 2, 3, 4], [2, 3, 4, 5], 0.17329),
    ([0, 1, 2, 3], [0, 0, 0, 3], 0.23869),
    ([5, 5], [5, 5], 0.0),
])
def test_jsd_goldens(spark, p, q, expected):
    out = fidelity.jsd(one_col(spark, p), one_col(spark, q), ["v"]).collect()
    assert out[0]["jsd"] == pytest.approx(expected, abs=1e-9)


def test_profile_golden(spark):
    r = profile.describe_profile(one_col(spark, [1, 2, 3, 4, 10]), ["v"]).collect()[0]
    assert (r["n"], r["mean"], r["min_v"], r["q1"], r["q2"], r["q3"], r["max_v"]) == (5, 4.0, 1.0, 2.0, 3.0, 4.0, 10.0)
    assert r["std"] == pytest.approx(3.5355339059, abs=1e-9)


def test_vote_goldens(spark):
    rows = [("X", "ssh"), ("X", "ssh"), ("X", "non-ssh"), ("Y", "ssh"), ("Y", "non-ssh"),
            (detect.DUMMY_ENDPOINT, "ssh"), (detect.DUMMY_ENDPOINT, "non-ssh")]
    df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(rows)], "id int, endpoint string, prediction string")
    got = {r["id"]: r["final"] for r in detect.majority_vote(df).collect()}
    assert [got[i] for i in range(len(rows))] == ["ssh", "ssh", "ssh", "non-ssh", "non-ssh", "ssh", "non-ssh"]


def test_metric_goldens(spark):
    counts = spark.createDataFrame([(0, 0, 0, 5), (2, 1, 2, 0)], "tp long, fp long, fn long, tn long")
    rows = detect.precision_recall_f1(counts).collect()
    assert (rows[0]["precision"], rows[0]["recall"], rows[0]["f1"]) == (0.0, 0.0, 0.0)
    assert rows[1]["precision"] == pytest.approx(2 / 3)
    assert rows[1]["recall"] == pytest.approx(0.5)
    assert rows[1]["f1"] == pytest.approx(0.5714285714)


@pytest.mark.parametrize("parsed,requested,accepted", [
    ([0, 25, 20], [20, 20, 20], [0, 20, 20]),
    ([20, 20, 20], [20, 20, 10], [20, 20, 10]),
])
def test_batch_accounting_goldens(spark, parsed, requested, accepted):
    df = spark.createDataFrame([(i + 1, p) for i, p in enumerate(parsed)], "batch long, parsed long")
    out = synth.batch_accounting(df, 50, 20).orderBy("batch").collect()
    assert [r["requested"] for r in out] == requested
    assert [r["accepted"] for r in out] == accepted


def test_clip_goldens(spark):
    prof = spark.createDataFrame([("v", 10.0, 100.0), ("w", -10.0, 100.0)], "feature string, min_v double, max_v double")
    df = spark.createDataFrame([(5.0, -20.0), (200.0, 0.0), (50.0, 5.0)], "v double, w double")
    out = clean.clip_to_profile(df, prof, ["v", "w"]).collect()
    assert [r["v"] for r in out] == pytest.approx([9.5, 105.0, 50.0])
    assert out[0]["w"] == pytest.approx(-9.5)


def test_inter_arrival_golden(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 1, 3, 6])], "s int, id int, sec long")
    df = df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    gaps = sorted(r["gap"] for r in features.ipa_gaps(df, "s", "ts", "id").collect())
    assert gaps == [1.0, 2.0, 3.0]
    st = features.session_time(df, "s", "ts", "id").collect()[0]
    assert st["ipa_mean"] == 2.0 and st["duration"] == 6.0 and st["residual"] == 0.0
    var = features.ipa_stats(df, "s", "ts", "id").collect()[0]["ipa_var"]
    assert math.isclose(var, 2 / 3)


def test_ipa_gaps_split_sessions_match_plain_lag(spark):
    """A tiny slice size forces many slices per session; the linked gaps
    must equal a plain per-session lag."""
    rows = [(s, i, (i * 7919 + s * 13) % 1000) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "s int, id int, sec long").withColumn(
        "ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    got = {(r["s"], r["id"]): r["gap"] for r in features.ipa_gaps(df, "s", "ts", "id", slice_rows=3).collect()}
    want = {}
    for s in range(3):
        seq = sorted([(sec, i) for ss, i, sec in rows if ss == s])
        for (a, _), (b, i) in zip(seq, seq[1:]):
            want[(s, i)] = float(b - a)
    assert got == want


def test_burst_is_cut_by_position(spark):
    """99 % of a session in one second: no slice holds much more than
    ``slice_rows``, and the gaps equal a plain lag."""
    n, slice_rows = 20_000, 1_000
    df = spark.range(n).select(F.lit(1).alias("s"), "id", F.timestamp_seconds(
        F.when(F.col("id") < n * 99 // 100, 0).otherwise(F.col("id"))).cast("timestamp_ntz").alias("ts"))
    sizes = [r["count"] for r in features._sliced(df, "s", "ts", "id", slice_rows).groupBy("_s", "_p").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 4 * slice_rows
    gaps = features.ipa_gaps(df, "s", "ts", "id", slice_rows)
    got = gaps.agg(F.count("*").alias("n"), F.sum("gap").alias("s"), F.max("gap").alias("m")).first()
    assert (got["n"], got["s"], got["m"]) == (n - 1, float(n - 1), n * 99 / 100)


def test_packets_without_time_or_session(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, None), ("a", 3, 5), (None, 4, 1), (None, 5, 9)],
                               "s string, id int, sec long")
    df = df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    for rows in (1, 500_000):
        assert [(r["s"], r["id"], r["gap"]) for r in features.ipa_gaps(df, "s", "ts", "id", rows).collect()] == [("a", 3, 5.0)]
    st = {r["s"]: r for r in features.session_stats(df, "s", "ts", "id").collect()}
    assert (st["a"]["n_packets"], st["a"]["duration"], st["a"]["ipa_mean"]) == (3, 5.0, 5.0)
    assert st[None]["n_packets"] == 2 and st[None]["ipa_mean"] is None


def test_profile_approximate_quartiles(spark):
    df = spark.range(1, 10001).selectExpr("CAST(id AS DOUBLE) AS v")
    r = profile.describe_profile(df, ["v"], approx_accuracy=10000).collect()[0]
    assert abs(r["q2"] - 5000.5) <= 2 and r["n"] == 10000 and r["max_v"] == 10000.0


def test_completion_with_concurrency(spark):
    prompts = synth.batch_plan(spark, 60, 20).withColumn("prompt", F.lit("p"))
    out = synth.completion_source(prompts, completer=lambda s, p: "[]", concurrency=2)
    assert out.rdd.getNumPartitions() == 2 and out.count() == 3
