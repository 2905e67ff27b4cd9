"""Forests on counted cells: bins, cuts, draws, layout, rows that do not fit a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthlens.operators import detect, forest


def _board(spark, n=6000):
    """Two features of many values, one constant; 10 % of the labels turned."""
    x, y = F.pmod(F.hash("id", F.lit(1)), F.lit(100_003)) / 100_003, F.pmod(F.hash("id", F.lit(2)), F.lit(7))
    turned = F.pmod(F.hash("id", F.lit(3)), F.lit(10)) == 0
    label = F.when(((x > 0.4) != (y > 3)) != turned, "ssh").otherwise("non-ssh")
    return spark.range(n).select("id", x.alias("x"), y.cast("int").alias("y"), F.lit(2.5).alias("z"), label.alias("label"))


def test_bins_hold_equal_shares_of_all_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 5).alias("few"), F.exp(F.col("id") / 100).alias("wide"),
                                    F.greatest(F.col("id") - 20_000, F.lit(0)).alias("heavy"), F.lit(1).alias("one"))
    few, wide, heavy, one = forest.bin_cuts(df, ["few", "wide", "heavy", "one"], 64)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0
    assert len(wide) == 63 and heavy[0] == 0.5 and 55 <= len(heavy) <= 63
    binned = forest.with_bins(df, ["wide", "heavy"], [wide, heavy])
    sizes = [r["count"] for r in binned.groupBy("_b0").count().collect()]
    assert len(sizes) == 64 and 300 < min(sizes) and max(sizes) < 1000
    assert max(r["count"] for r in binned.where("_b1 > 0").groupBy("_b1").count().collect()) < 600
    again = forest.bin_cuts(df.repartition(7, "wide"), ["few", "wide", "heavy", "one"], 64)
    assert all(np.array_equal(a, b) for a, b in zip((few, wide, heavy, one), again))


def test_extreme_values_are_binned(spark):
    values = [float("-inf"), -1e300, -1.0, -0.0, 0.0, 5e-324, 1.0, float(np.nextafter(1.0, 2.0)), 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values for _ in range(3)], "x double")
    cuts = forest.bin_cuts(df, ["x"], 64)
    got = {(r["x"], r["_b0"]) for r in forest.with_bins(df, ["x"], cuts).collect()}
    assert len(cuts[0]) == 8 and sorted({b for _, b in got}) == list(range(9))  # both zeros are one value


def test_rows_without_a_number_stop_the_fit(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (2.0, "b")], "x double, l string")
    with pytest.raises(Exception, match="null or NaN"):
        detect.rf_predict(df, df, ["x"], "l", num_trees=2)


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, (300, 2)).astype(np.uint16), rng.integers(0, 3, 300)
    w, node = rng.integers(1, 9, 300).astype(float), rng.integers(0, 4, 300)
    counts = np.bincount(node * 3 + y, w, 12).reshape(4, 3)
    feature, cut = forest._best_cuts(x, y, w, node, counts, np.array([[0, 1]] * 4), 6)

    def impurity(m):
        held = np.bincount(y[m], w[m], 3)
        return held.sum() - (held ** 2).sum() / held.sum() if m.any() else np.inf

    for k in range(4):
        tried = {(f, c): impurity((node == k) & (x[:, f] <= c)) + impurity((node == k) & (x[:, f] > c)) for f in (0, 1) for c in range(5)}
        assert tried[feature[k], cut[k]] == pytest.approx(min(tried.values()))


def test_a_cell_is_drawn_as_often_as_its_rows():
    """Three rows of one label, one of the other: the share of the first is 3/4 on the mean."""
    x, y = np.zeros((2, 1), np.uint16), np.array([0, 1])
    share = [forest.grow_tree(x, y, np.array([300, 100]), 2, 1, 30, 1.0, np.random.default_rng(i))[3][0, 0] / forest.ONE for i in range(400)]
    # a bootstrap of 400 rows: its share has a deviation of 0.0217; whole cells drawn at once would give far more
    assert np.mean(share) == pytest.approx(0.75, abs=0.005) and 0.018 < np.std(share) < 0.026


def test_forests_grow_on_counted_cells(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"),
                                    F.when(F.col("id") % 3 == 0, "ssh").otherwise("non-ssh").alias("label"))
    model = forest.training_cells(df, ["a", "b"], "label", 64)
    assert model.labels == ["non-ssh", "ssh"] and len(model.counts) == 12 and model.counts.sum() == 50_000


def test_predictions_do_not_depend_on_the_layout(spark):
    df = _board(spark)
    runs = []
    for layout in (df.coalesce(1), df.repartition(5, "y")):
        pred = detect.rf_predict(layout.where("id % 2 = 0"), layout.where("id % 2 = 1"), ["x", "y", "z"], "label", num_trees=25, seed=4)
        assert pred.columns == [*df.columns, "prediction"]
        runs.append({r["id"]: (r["label"], r["prediction"]) for r in pred.collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 3000
    assert np.mean([a == b for a, b in runs[0].values()]) > 0.8


def test_repeats_are_forests_of_their_own(spark):
    df = _board(spark, 2000)
    model = forest.training_cells(df, ["x", "y"], "label", 64)
    said = forest.vote_on(model, df, [1, 2, 1], 3, 30).collect()
    assert len(said) == 2000 and all(len(r["_said"]) == 3 and r["_said"][0] == r["_said"][2] for r in said)
    assert any(r["_said"][0] != r["_said"][1] for r in said)


@pytest.mark.parametrize("cells", ["MAX_CELLS of the rows", "MAX_CELLS of the test rows"])
def test_sets_of_too_many_cells_are_fitted_by_rows_in_groups(spark, monkeypatch, cells):
    from pyspark.ml.classification import RandomForestClassifier

    df, sizes = _board(spark, 4000), []
    if cells == "MAX_CELLS of the rows":
        monkeypatch.setattr(forest, "MAX_CELLS", 100)
    else:
        monkeypatch.setattr(forest, "vote_on", lambda *args: None)
    monkeypatch.setattr(detect, "FIT_BYTES", detect.TREE_ROW_BYTES * 2000 * 4)  # four trees over 2,000 rows
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: sizes.append(self.getNumTrees()) or fit(self, rows))
    pred = detect.rf_predict(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["x", "y", "z"], "label", num_trees=10, max_depth=6)
    rows = pred.collect()
    assert sizes == [4, 4, 2] and len(rows) == 2000 and pred.columns == [*df.columns, "prediction"]
    assert np.mean([r["label"] == r["prediction"] for r in rows]) > 0.8


def test_experiment_fitted_by_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "MAX_CELLS", 100)
    df = _board(spark, 2000).withColumn("endpoint", (F.col("id") % 200).cast("string"))
    out = detect.detection_experiment([("m", df)], df, ["x", "y"], "label", n_repeat=2, num_trees=3, max_depth=5).collect()
    assert [(r["mode"], r["runs"]) for r in out] == [("m", 2)] and out[0]["f1"] > 0


def test_no_rows_are_kept_per_tree(spark, monkeypatch):
    """100 trees on 3,000 rows in 42 cells: no fit by rows, which keeps 1.3 KB of draws and nodes beside each."""
    monkeypatch.setattr(detect, "fit_forest", None)
    df = _board(spark, 3000).withColumn("x", F.floor(F.col("x") * 3))
    pred = detect.rf_predict(df, df, ["x", "y"], "label", num_trees=100)
    assert pred.count() == 3000 and forest.training_cells(df, ["x", "y"], "label", 64).counts.size == 42
