"""Forest, experiment, 2-D embedding."""

import numpy as np
from pyspark.sql import functions as F

from synthlens.operators import detect, fidelity
from synthlens.plans import fixtures as fx


def test_forest_on_separable_data(spark, sf_small):
    f = fx.flows(spark, sf_small).withColumn("label", F.when(F.col("l_quantity") > 25, "ssh").otherwise("non-ssh"))
    tr, te = f.where(F.col("grp") == "F"), f.where(F.col("grp") == "O")
    pred = detect.rf_predict(tr, te, ["l_quantity", "l_extendedprice"], "label", num_trees=5, max_depth=4, seed=1)
    pred = pred.withColumn("endpoint", F.monotonically_increasing_id().cast("string"))
    m = detect.precision_recall_f1(detect.confusion_counts(pred, "label", "prediction")).collect()[0]
    assert m["f1"] > 0.97
    assert pred.count() == te.count()


def test_pc_feature_train_range(spark, sf_small):
    f = fx.flows(spark, sf_small)
    tr, te = detect.pc_feature(f.where(F.col("grp") == "F"), f.where(F.col("grp") == "O"), fx.FLOW_FEATURES)
    r = tr.agg(F.min("PC").alias("a"), F.max("PC").alias("b")).collect()[0]
    assert abs(r["a"]) < 1e-9 and abs(r["b"] - 100.0) < 1e-9
    assert te.count() == f.where(F.col("grp") == "O").count()


def test_embedding_axes(spark, sf_small):
    f = fx.flows(spark, sf_small)
    emb = fidelity.embedding_2d(f, fx.FLOW_FEATURES, keep=["grp"]).toPandas()
    assert len(emb) == f.count()
    x, y = emb["x"].to_numpy(), emb["y"].to_numpy()
    assert abs(np.corrcoef(x, y)[0, 1]) < 1e-6      # orthogonal axes: uncorrelated coordinates
    assert x.var() >= y.var()                         # variances ordered
    assert abs(x.mean()) < 1e-9 and abs(y.mean()) < 1e-9


def test_detection_experiment_learns(spark, sf_small):
    from synthlens.plans.queries import _experiment_sets

    sets, test = _experiment_sets(spark, sf_small)
    out = detect.detection_experiment(sets[:2], test, fx.FLOW_FEATURES, "label", n_repeat=2, num_trees=10, max_depth=6).collect()
    assert sorted(r["mode"] for r in out) == ["baseline_a", "original"]
    for r in out:
        assert 0.5 < r["f1"] < 1.0 and r["runs"] == 2  # the vote changes rows


def test_null_labels_are_not_learned(spark):
    rows = [(float(i), "ssh" if i > 10 else "non-ssh" if i else None) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, label string")
    out = detect.rf_predict(df, df, ["x"], "label", num_trees=3, max_depth=3)
    assert {r["prediction"] for r in out.collect()} == {"ssh", "non-ssh"}


def test_forests_are_not_counted_one_by_one(spark, sf_small, monkeypatch):
    """The scored rows of all forests reach one aggregate without a shuffle per forest."""
    from synthlens.plans.queries import _experiment_sets

    plans = []
    score = detect.score_from_counts

    def seen(counts, *args):
        plans.append(counts._jdf.queryExecution().executedPlan().toString())
        return score(counts, *args)

    monkeypatch.setattr(detect, "score_from_counts", seen)
    sets, test = _experiment_sets(spark, sf_small)
    test = test.limit(200).repartition(3).localCheckpoint()
    detect.detection_experiment(sets[:1], test, fx.FLOW_FEATURES, "label", n_repeat=3, num_trees=2, max_depth=3)
    assert plans and "Union" in plans[0] and "Exchange" not in plans[0]


def test_training_sets_are_dealt_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(detect, "FIT_ROWS", 100)
    rows = [(float(i % 7), float(i), "ssh" if i % 2 else "non-ssh") for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, y double, label string").coalesce(1)
    first, second = ([[(r["_features"].toArray().tolist(), r["_label"]) for r in p] for p in parts] for parts in
                     (detect.prepare_training(df, ["x", "y"], "label")[0].rdd.glom().collect() for _ in range(2)))
    assert first == second  # so a seed draws the same rows again
    assert sum(map(len, first)) == 2000 and max(map(len, first)) <= 150


def test_experiment_is_fitted_on_all_rows(spark, tmp_path, monkeypatch):
    """The query bounds no training set: over 20,000 rows, each reaches the fits."""
    from synthlens.plans.queries import QUERIES

    n = 21_000
    li = spark.range(2 * n).select(
        F.when(F.col("id") < n, "F").otherwise("O").alias("l_linestatus"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 7 % 1009 + 900).cast("double").alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"),
        (F.col("id") % 9 / 100).alias("l_tax"), (F.col("id") % 10).alias("l_suppkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    run, seen = detect.detection_experiment, {}

    def small(sets, test, features, label, **kw):
        seen.update({name: train.count() for name, train in sets})
        return run(sets[:1], test, features, label, **{**kw, "n_repeat": 1, "num_trees": 2, "max_depth": 3})

    def read(*args, f=detect.forest.training_cells):
        model = f(*args)
        seen["fitted"] = model.counts.sum()
        return model

    monkeypatch.setattr(detect, "detection_experiment", small)
    monkeypatch.setattr(detect.forest, "training_cells", read)
    assert QUERIES["detection_experiment"](spark, str(tmp_path)).count() == 1
    assert seen["fitted"] == seen["original"] == n
