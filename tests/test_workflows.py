"""End-to-end runs on small sheets written from the sf0.001 tables."""

import json

from pyspark.sql import functions as F

from synthlens.plans import fixtures as fx
from synthlens.plans import workflows as wf
from synthlens.session import scratch_dir
from synthlens.sources import files
from synthlens.sources.catalog import DatasetSpec

FEATS = fx.FLOW_FEATURES


def _sheet(spark, df, name, index_col=None):
    return files.write_sheet(df, scratch_dir(spark, name), index_col=index_col)


def test_synthesize_with_completer(spark, sf_small):
    flows = fx.flows(spark, sf_small).withColumn("LABEL", F.col("label")).withColumn("_row", F.lit(0))
    path = _sheet(spark, flows.select("_row", "LABEL", *FEATS), "orig", index_col="_row")
    real = wf.load_real(spark, path, FEATS, n=200)
    assert real.count() == 200

    def completer(system, prompt):
        k = int(prompt.split("(batch ")[1].split(" ")[0])
        if k == 2:
            return "Sorry, no."  # a failed batch
        return "```json\n" + json.dumps([{f: 10.0 + i for f in FEATS} for i in range(25)]) + "\n```"

    specs = [wf.synth.FeatureSpec(f, f, f) for f in FEATS]
    recs, outcomes, prompts = wf.synthesize(spark, real, FEATS, specs, n=50, batch_size=20, completer=completer,
                                            label_col="LABEL")
    o = outcomes.collect()[0]
    assert (o["planned"], o["failed"], o["accepted"]) == (3, 1, 40)
    assert recs.count() == 40 and prompts.count() == 3
    assert "statistics only" in prompts.collect()[0]["prompt"]


def test_fidelity_report_simulated_and_file(spark, sf_small):
    flows = fx.flows(spark, sf_small)
    original = flows.where(F.col("grp") == "F").select(*FEATS)
    b_path = _sheet(spark, flows.where(F.col("grp") == "O").select(*FEATS), "llm")
    t = wf.fidelity_report(spark, original, a_path=None, b_path=b_path, features=FEATS, n=500)
    prov = {r["source"]: r["simulated"] for r in t["provenance"].collect()}
    assert prov == {"A": True, "B": False}
    jsd = {r["feature"]: r for r in t["jsd"].collect()}
    assert set(jsd) == set(FEATS) | {"__mean__"}
    counts = {r["grp"]: r["n"] for r in t["counts"].collect()}
    assert counts["B"] == 500 and counts["A"] == 500
    assert t["hexbin"].count() > 0 and t["box"].count() == 3 * len(FEATS)


def test_load_synthetic_a(spark, sf_small):
    """Index column, label by its second name, fractions, one feature absent."""
    flows = fx.flows(spark, sf_small).select(F.lit(7).alias("_row"), F.col("label").alias("LABEL"),
                                             (F.col("l_quantity") / 100).alias("l_quantity"), "l_discount", "l_tax")
    path = _sheet(spark, flows, "a", index_col="_row")
    a = wf.load_synthetic_a(spark, path, FEATS, n=100)
    row = a.agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p")).first()
    assert row["n"] == 100 and 1 < row["q"] <= 50 and row["p"] == 0.0
    t = wf.fidelity_report(spark, fx.flows(spark, sf_small).where("grp = 'F'").select(*FEATS), a_path=path, features=FEATS, n=100)
    audit = {r["source"]: r for r in t["load_audit"].collect()}
    n_ssh = flows.where("LABEL = 'ssh'").count()
    assert (audit["A"]["n_total"], audit["A"]["n_label"], audit["A"]["n_selected"]) == (flows.count(), n_ssh, 100)
    assert audit["B"]["simulated"] and not audit["A"]["simulated"] and not audit["original"]["simulated"]


def test_detector_comparison(spark, sf_small):
    root = scratch_dir(spark, "datasets")
    li = fx.table(spark, sf_small, "lineitem")
    rows = li.select(F.when(F.col("l_quantity") > 25, "ssh").otherwise("non-ssh").alias("LABEL"),
                     F.col("l_suppkey").cast("string").alias("Destination"), F.lit(22).alias("Destination Port"),
                     "l_linestatus", *FEATS)
    spec = DatasetSpec(name="t", real_dir="real", fake_dir="fake", train_file="train.csv",
                       test_files={"test": "test.csv"}, features=tuple(FEATS), label_col="LABEL",
                       pca_cols=("l_quantity", "l_extendedprice"), model_cols=("PC", "l_discount", "l_tax"),
                       synthetic_dirs={"llm": "LLM"}, synthetic_files={"llm": ("missing.csv", "synthetic_ssh.csv")})
    files.write_sheet(rows.where(F.col("l_linestatus") == "F").drop("l_linestatus"), spec.train_path(root))
    files.write_sheet(rows.where(F.col("l_linestatus") == "O").drop("l_linestatus"), spec.test_path(root, "test"))
    fake = li.where(F.col("l_quantity") > 40).select(F.lit("SSH").alias("label"), *FEATS)
    files.write_sheet(fake, f"{root}/fake/LLM/synthetic_ssh.csv")
    out = wf.detector_comparison(spark, spec, root, "test", n_repeat=1, modes=("original", "llm"),
                                 num_trees=3, max_depth=4).collect()
    assert sorted(r["mode"] for r in out) == ["llm", "original"]
    assert all(0.0 <= r["f1"] <= 1.0 for r in out)
