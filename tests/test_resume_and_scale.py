"""Resumed replies, running sums over blocks of blocks, sketches of distinct
sources, audits gathered while writing, deep trees, repeated vectors."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from synthlens.operators import detect, features, report, synth
from synthlens.plans import fixtures as fx
from synthlens.session import scratch_dir


def _prompts(spark, batches):
    return spark.createDataFrame([(b, f"prompt {b}") for b in batches], "batch long, prompt string")


def _logged(folder, fail=(), stop=None):
    """Answers with the prompt, notes every call in a file, fails for some
    prompts and ends the whole run at one of them."""
    def completer(system, prompt):
        if stop and os.path.exists(f"{folder}/armed") and prompt == stop:
            raise SystemExit("the run ends here")
        with open(f"{folder}/calls", "a") as f:
            f.write(prompt + "\n")
        if prompt in fail:
            raise ValueError("no answer")
        return f"re: {prompt}"
    return completer


def _calls(folder):
    with open(f"{folder}/calls") as f:
        return sorted(f.read().split("\n")[:-1])


def test_run_that_ended_asks_each_batch_once(spark):
    folder, path = tempfile.mkdtemp(prefix="synthlens-test-"), scratch_dir(spark, "kept-replies")
    batches = [1, 2, 3, 4, 5, 6, 9, 10, 11, 40]  # numbers with gaps
    prompts = _prompts(spark, batches).coalesce(1)
    open(f"{folder}/armed", "w").close()
    completer = _logged(folder, fail=("prompt 2",), stop="prompt 9")
    with pytest.raises(Exception):  # noqa: B017
        synth.resumed_replies(prompts, completer, path, per_write=3)
    assert _calls(folder) == [f"prompt {b}" for b in range(1, 7)]
    os.rename(f"{folder}/armed", f"{folder}/disarmed")
    out = synth.resumed_replies(prompts, completer, path, per_write=3).orderBy("batch").collect()
    assert _calls(folder) == sorted(f"prompt {b}" for b in batches)
    assert [r["batch"] for r in out] == batches
    assert [r["response"] for r in out] == [None if b == 2 else f"re: prompt {b}" for b in batches]
    assert [r["error"] for r in out] == ["ValueError: no answer" if b == 2 else None for b in batches]
    # nothing is left to ask; a failed batch only on request
    assert synth.resumed_replies(prompts, completer, path, per_write=3).count() == len(batches)
    assert len(_calls(folder)) == len(batches)
    again = synth.resumed_replies(prompts, _logged(folder), path, per_write=100, ask_failed=True)
    assert {r["batch"]: r["response"] for r in again.collect()}[2] == "re: prompt 2"
    assert again.where(F.col("error").isNotNull()).count() == 0
    assert len(_calls(folder)) == len(batches) + 1


def test_resumed_replies_of_no_prompts(spark):
    out = synth.resumed_replies(_prompts(spark, [1]).limit(0), lambda s, p: p, scratch_dir(spark, "kept-replies"))
    assert out.columns == ["batch", "response", "error"] and out.count() == 0
    with pytest.raises(ValueError):
        synth.resumed_replies(spark.createDataFrame([(None, "x")], "batch long, prompt string"), lambda s, p: p,
                              scratch_dir(spark, "kept-replies"))


@pytest.mark.parametrize("block", [2, 7, 65_536])
def test_running_total_over_levels(spark, block):
    keys = [0, 1, 2, 3, 5, 8, 13, 63, 64, 65, 400]
    df = spark.createDataFrame([(k, k % 5 + 1) for k in keys], "k long, v long")
    out = {r["k"]: r["s"] for r in synth.running_total(df, "k", "v", "s", block=block).collect()}
    assert out == {k: sum(j % 5 + 1 for j in keys if j <= k) for k in keys}
    assert synth.running_total(df.limit(0), "k", "v", "s", block=block).count() == 0


def test_batch_accounting_has_no_single_task(spark):
    parsed = spark.range(1, 2000).select(F.col("id").alias("batch"), (F.col("id") % 30).alias("parsed"))
    plan = synth.batch_accounting(parsed, 40_000, 20)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_sketches_of_periods(spark):
    conns = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("dst"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 20_011).alias("src"), (F.col("id") % 4).alias("day"))
    days = features.connection_sketches(conns, "dst", "src", F.col("day"))
    parts = days.where("period < 2").unionByName(days.where("period >= 2"))
    got = {r["dst"]: r for r in features.stats_from_sketches(parts, "dst").collect()}
    exact = {r["dst"]: r for r in features.connection_stats(conns, "dst", "src").collect()}
    assert got.keys() == exact.keys()
    for k, r in exact.items():
        assert got[k]["total"] == r["total"]
        assert abs(got[k]["n_sources"] - r["n_sources"]) <= 0.05 * r["n_sources"]
    none = spark.createDataFrame([("a", None), (None, 1)], "dst string, src long")
    rows = features.stats_from_sketches(features.connection_sketches(none, "dst", "src", F.lit(1)), "dst").collect()
    assert {(r["dst"], r["total"], r["n_sources"], r["avg_per_source"]) for r in rows} == {("a", 1, 0, None), (None, 1, 1, 1.0)}


def test_audit_of_a_load_reads_its_source_once(spark, sf_small):
    rows = [("ssh", 1.0, 2.0), ("ssh", None, 2.0), ("x", 1.0, 1.0), (None, 1.0, None), ("ssh", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "label string, a double, b double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = df.mapInArrow(count, df.schema)
    loaded, audit = report.load_audited("s", once, F.col("label") == "ssh", ["a", "b"], scratch_dir(spark, "load"), False, 1)
    assert audit.collect() == report.load_audit("s", df, F.col("label") == "ssh", ["a", "b"], False, 1).collect()
    assert tuple(audit.first()) == ("s", 5, 3, 2, 1, False)
    assert loaded.count() == 5 and seen.value == 5
    empty = report.load_audited("e", df.limit(0), None, ["a"], scratch_dir(spark, "load"), True)[1]
    assert tuple(empty.first()) == ("e", 0, 0, 0, 0, True)


def _f1(spark, sf_dir, depth):
    """Labels by a board of small fields: no single threshold helps."""
    f = fx.flows(spark, sf_dir)
    board = (F.floor(F.col("l_quantity") / 5) + F.floor(F.col("l_discount") * 50)) % 2
    f = f.withColumn("label", F.when(board == 0, "ssh").otherwise("non-ssh"))
    cols = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    pred = detect.rf_predict(f.where("grp = 'F'"), f.where("grp = 'O'"), cols, "label", num_trees=20, max_depth=depth, seed=3)
    pred = pred.withColumn("endpoint", F.monotonically_increasing_id().cast("string"))
    return detect.precision_recall_f1(detect.confusion_counts(pred, "label", "prediction")).first()["f1"]


def test_deep_trees_learn_finer_structure(spark, sf_small):
    assert detect.MAX_DEPTH == 30
    shallow, deep = _f1(spark, sf_small, 5), _f1(spark, sf_small, detect.MAX_DEPTH)
    assert deep > shallow


def test_vector_in_every_batch_is_split(spark):
    """One vector in every batch, others unique: the join of counts and
    totals is dealt anew on both sides, so Spark may split the hot key."""
    records = spark.range(4_000).select(F.floor(F.col("id") / 2).alias("batch"), (F.col("id") % 2).alias("pos"),
                                        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") + 10.0).alias("x"))
    prof = spark.createDataFrame([("x", 1.0, 1e6)], "feature string, min_v double, max_v double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = synth.record_audit(records, prof, ["x"])
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 2000 and all(r["n_duplicate"] == 1 and r["n_records"] == 2 for r in rows)
    assert "skewed" in plan or "skew=true" in plan.lower()
