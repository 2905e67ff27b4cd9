"""Detector experiment: first-component feature, forest, per-endpoint
majority vote, confusion counts and metrics (A04, A10-A13, J02, J03, F09,
M01, M04, M05, U01).

The vote is a hash aggregate per endpoint (map-side combined) joined back,
not a window: when the destination is absent every row shares one endpoint,
and a window would put the whole table into one task. The vote table's size
in bytes decides between a broadcast and a shuffle join. The experiment
needs no join at all: it scores from counts per endpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthlens.functions.numeric import minmax_100, ratio_or_zero
from synthlens.operators import forest
from synthlens.operators.clean import NON_SSH, SSH, SYNTH_ENDPOINT
from synthlens.operators.joins import join_checked, written
from synthlens.session import shared_dir

MAX_DEPTH = 30  # the deepest tree that Spark ML grows; the compared trees have no limit
MAX_BINS = 64  # bins of a feature
FIT_ROWS = 200_000  # rows of one partition of a training set; every pass of 100 trees reads about 1.3 KB a row
FIT_BYTES = 2 << 30  # what the rows of a fit keep at once of draws and nodes
TREE_ROW_BYTES = 13  # of them, per row and tree
DUMMY_ENDPOINT = f"{SYNTH_ENDPOINT[0]}:{SYNTH_ENDPOINT[1]}"


def covariance(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """A04 as a matrix: one aggregate row of ``covar_samp`` terms (upper
    triangle), assembled on the driver (k x k, constant size)."""
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    c = np.zeros((k, k))
    for i, j in pairs:
        v = row[f"c{i}_{j}"]
        c[i, j] = c[j, i] = np.nan if v is None else v
    return c


def fix_sign(v: np.ndarray) -> np.ndarray:
    """Make the largest-magnitude entry positive."""
    return v if v[int(np.argmax(np.abs(v)))] >= 0 else -v


def principal_axes(df: DataFrame, cols: Sequence[str], k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Top-``k`` eigenvectors (columns) of the sample covariance and their
    eigenvalues, signs fixed."""
    vals, vecs = np.linalg.eigh(covariance(df, cols))
    order = np.argsort(vals)[::-1][:k]
    axes = np.column_stack([fix_sign(vecs[:, i]) for i in order])
    return axes, vals[order]


def pc_feature(train: DataFrame, test: DataFrame, cols: Sequence[str], out: str = "PC") -> tuple[DataFrame, DataFrame]:
    """Uncentred projection on the top covariance eigenvector of
    the train columns, scaled to 0-100 by the train range; the test uses the
    train scalars (and may leave 0-100)."""
    axis = principal_axes(train, cols, 1)[0][:, 0]
    proj = sum((F.col(c).cast("double") * F.lit(float(axis[i])) for i, c in enumerate(cols)), F.lit(0.0))
    tr = train.withColumn("_pc", proj)
    te = test.withColumn("_pc", proj)
    rng = tr.agg(F.min("_pc").alias("_pmin"), F.max("_pc").alias("_pmax"))
    rng = rng.sparkSession.createDataFrame(rng.collect(), rng.schema)  # one row, found once for all uses of the feature
    return train_scalar_apply(tr, te, rng, out)


def train_scalar_apply(tr: DataFrame, te: DataFrame, rng: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """One-row train scalars (min/max) broadcast onto train and test."""
    def scale(d):
        return (d.crossJoin(F.broadcast(rng))
                .withColumn(out, minmax_100(F.col("_pc"), F.col("_pmin"), F.col("_pmax")))
                .drop("_pc", "_pmin", "_pmax"))
    return scale(tr), scale(te)


def minmax_scale(train: DataFrame, target: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """scale ``col`` of ``target`` to 0-100 by the train min/max (a
    constant train range divides by 1)."""
    rng = train.agg(F.min(col).alias("_pmin"), F.max(col).alias("_pmax"))
    return (target.crossJoin(F.broadcast(rng))
            .withColumn(out or col, minmax_100(F.col(col).cast("double"), F.col("_pmin"), F.col("_pmax")))
            .drop("_pmin", "_pmax"))


def endpoint_votes(df: DataFrame, endpoint_col: str = "endpoint", pred_col: str = "prediction",
                   exempt: Sequence[str] = (DUMMY_ENDPOINT,)) -> DataFrame:
    """A10: per endpoint the ssh and non-ssh votes and the majority (``ssh``
    iff ssh votes outnumber non-ssh votes; a tie gives non-ssh). Exempt
    endpoints are not voted on. A hash aggregate, combined map-side."""
    return (df.where(~F.col(endpoint_col).isin(list(exempt)))
            .groupBy(endpoint_col)
            .agg(F.count_if(F.col(pred_col) == SSH).alias("n_ssh"),
                 F.count_if(F.col(pred_col) == NON_SSH).alias("n_non"))
            .withColumn("majority", F.when(F.col("n_ssh") > F.col("n_non"), F.lit(SSH)).otherwise(F.lit(NON_SSH))))


def majority_vote(df: DataFrame, endpoint_col: str = "endpoint", pred_col: str = "prediction",
                  exempt: Sequence[str] = (DUMMY_ENDPOINT,), out: str = "final") -> DataFrame:
    """Every member row takes its endpoint's majority, except
    rows of an exempt endpoint, which keep their own prediction."""
    votes = endpoint_votes(df, endpoint_col, pred_col, exempt).select(endpoint_col, F.col("majority").alias("_major"))
    joined = join_checked(df, votes, endpoint_col, "left")
    return joined.withColumn(out, F.coalesce(F.col("_major"), F.col(pred_col).cast("string"))).drop("_major")


def confusion_counts(df: DataFrame, truth_col: str, pred_col: str, group_cols: Sequence[str] = (),
                     positive: str = SSH) -> DataFrame:
    """TP/FP/FN/TN; anything other than ``positive`` is negative."""
    t, p = F.col(truth_col) == positive, F.col(pred_col) == positive
    t, p = F.coalesce(t, F.lit(False)), F.coalesce(p, F.lit(False))
    aggs = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
            F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """A zero denominator gives 0.0."""
    prec = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": prec, "recall": rec})
    return out.withColumn("f1", ratio_or_zero(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                              F.col("precision") + F.col("recall")))


def repeat_average(scored: DataFrame, mode_col: str = "mode", run_col: str = "run",
                   truth_col: str = "truth", pred_col: str = "final") -> DataFrame:
    """Metrics per (mode, run), then the mean of each metric per mode
    (a mean of ratios, not a ratio of sums)."""
    per_run = precision_recall_f1(confusion_counts(scored, truth_col, pred_col, [mode_col, run_col]))
    return per_run.groupBy(mode_col).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                         F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("runs"))


def augment_union(real: DataFrame, synthetic: DataFrame | None) -> DataFrame:
    """Append synthetic rows by column name; missing columns are NULL."""
    return real if synthetic is None else real.unionByName(synthetic, allowMissingColumns=True)


def dealt_evenly(rows: DataFrame) -> DataFrame:
    """``rows`` in partitions of about ``FIT_ROWS`` at most, however large
    the splits of its files are. The order in each is fixed, so a seeded fit
    draws the same rows on every run over the same input."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS))
    return rows.repartition(parts).sortWithinPartitions(*rows.columns)


def prepare_training(train: DataFrame, features: Sequence[str], label_col: str):
    """Index the label and assemble the feature vector once (shared by all
    forests of a training set), in partitions of bounded size. Returns
    ``(assembled train, labels)``."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    train = train.where(F.col(label_col).isNotNull())  # a row without a label teaches nothing
    train = dealt_evenly(train.select(*features, label_col))
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="error").fit(train)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    return assembler.transform(indexer.transform(train)).select("_features", "_label"), list(indexer.labels)


def fit_forest(assembled: DataFrame, num_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 0,
               max_bins: int = MAX_BINS, subsampling_rate: float = 1.0, level_mb: int = 1024):
    """M04 fit: Spark ML trains the trees as distributed tasks over binned
    features (one pass per tree level for all trees together, as long as the
    level's statistics fit in ``level_mb``). Each row keeps the node it has
    reached in each tree, so a pass does not send the trees grown so far nor
    walk them again; these node numbers are written to the checkpoint folder
    every ten passes, which keeps their lineage short. Draws and nodes take
    ``TREE_ROW_BYTES`` per row and tree: where those of all trees exceed
    ``FIT_BYTES``, the trees are fitted in groups, one after the other."""
    from pyspark.ml.classification import RandomForestClassifier

    spark = assembled.sparkSession
    shared_dir(spark)
    most = max(1, FIT_BYTES // (TREE_ROW_BYTES * max(1, assembled.count())))
    models = []
    for first in range(0, num_trees, most):
        trees = RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_pidx",
                                       numTrees=min(most, num_trees - first), maxDepth=max_depth,
                                       seed=seed + 1_000_003 * first, maxBins=max_bins,
                                       featureSubsetStrategy="sqrt", subsamplingRate=subsampling_rate,
                                       bootstrap=True, cacheNodeIds=True, checkpointInterval=10,
                                       maxMemoryInMB=level_mb)
        models.append(trees.fit(assembled))
        # The training summary holds the session and goes with the model to every task; a session that has observed
        # metrics cannot be sent.
        models[-1]._java_obj.setSummary(spark._jvm.scala.Option.empty())
    return models[0] if len(models) == 1 else _united(spark, models)


def _united(spark, models):
    """One forest of the trees of all ``models``."""
    from pyspark.ml.classification import RandomForestClassificationModel

    java = [m._java_obj for m in models]
    trees = [t for m in java for t in m.trees()]
    ml = spark._jvm.org.apache.spark.ml.classification
    array = spark.sparkContext._gateway.new_array(ml.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    out = RandomForestClassificationModel(ml.RandomForestClassificationModel(java[0].uid(), array, java[0].numFeatures(),
                                                                             java[0].numClasses()))
    return out.setFeaturesCol("_features").setPredictionCol("_pidx")


def predict_forest(model, labels: Sequence[str], test: DataFrame, features: Sequence[str],
                   keep: Sequence[str] = ()) -> DataFrame:
    """M04 predict: label text in ``prediction`` for every test row."""
    from pyspark.ml.feature import IndexToString, VectorAssembler

    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    back = IndexToString(inputCol="_pidx", outputCol="prediction", labels=list(labels))
    pred = back.transform(model.transform(assembler.transform(test)))
    return pred.select(*keep, *[c for c in test.columns if c not in keep], "prediction")


def rf_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label_col: str,
               num_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 0, max_bins: int = MAX_BINS,
               subsampling_rate: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Random forest fit on the train features, predicted labels on the
    test rows (``prediction`` as the original label text). The trees grow on
    the counted cells of the bins (``operators.forest``); where those are too
    many for a task, on the rows."""
    model = forest.training_cells(train, features, label_col, max_bins)
    said = model and forest.vote_on(model, test, [seed], num_trees, max_depth, subsampling_rate)
    if said is None:
        assembled, labels = prepare_training(train, features, label_col)
        assembled = assembled.persist()
        fitted = fit_forest(assembled, num_trees, max_depth, seed, max_bins, subsampling_rate)
        assembled.unpersist()
        return predict_forest(fitted, labels, test, features, keep)
    pred = said.withColumn("prediction", forest.said_label(model.labels, 0))
    return pred.select(*keep, *[c for c in test.columns if c not in keep], "prediction")


def score_from_counts(counts: DataFrame, group_cols: Sequence[str], endpoint_col: str = "endpoint",
                      exempt: Sequence[str] = (DUMMY_ENDPOINT,)) -> DataFrame:
    """Vote and confusion counts from ``(groups, endpoint, truth, prediction,
    n)``: per endpoint the majority follows from the counts, so no row is
    read again. NULL endpoints vote as one endpoint."""
    own = F.coalesce(F.col(endpoint_col).isin(list(exempt)), F.lit(False))
    truth = F.coalesce(F.col("truth") == SSH, F.lit(False))
    ssh = F.coalesce(F.col("prediction") == SSH, F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = counts.groupBy(*group_cols, endpoint_col).agg(
        F.first(own).alias("_own"), total(truth & ssh).alias("a"), total(~truth & ssh).alias("b"),
        total(truth & ~ssh).alias("c"), total(~truth & ~ssh).alias("d"))
    major = F.col("a") + F.col("b") > F.col("c") + F.col("d")
    kept = lambda c, yes, no: F.when(F.col("_own"), F.col(c)).when(major, yes).otherwise(no)
    zero = F.lit(0)
    return per.groupBy(*group_cols).agg(
        F.sum(kept("a", F.col("a") + F.col("c"), zero)).alias("tp"), F.sum(kept("b", F.col("b") + F.col("d"), zero)).alias("fp"),
        F.sum(kept("c", zero, F.col("a") + F.col("c"))).alias("fn"), F.sum(kept("d", zero, F.col("b") + F.col("d"))).alias("tn"))


def detection_experiment(train_sets: Sequence[tuple[str, DataFrame]], test: DataFrame, features: Sequence[str],
                         label_col: str, pca_cols: Sequence[str] | None = None, n_repeat: int = 10,
                         num_trees: int = 100, max_depth: int = MAX_DEPTH, base_seed: int = 7,
                         endpoint_col: str = "endpoint", parallel_fits: int = 4) -> DataFrame:
    """For each training mode, optional first-component feature, then
    ``n_repeat`` forests (seed = base + run), per-endpoint vote, metrics, and
    the mean per mode. The forests of a mode grow on the counted cells of its
    training set and vote on the cells of the test set; the test rows are then
    counted once per mode, by endpoint, label and what all its forests say. The
    counts of all forests meet in one aggregate per (mode, run, endpoint),
    combined map-side and dealt by all three, and votes and metrics come from
    it. (Counted forest by forest, the small results of all would be read by
    the same few tasks.) A mode with too many cells for a task is fitted row by
    row, up to ``parallel_fits`` forests at a time, and each of its forests
    scores the test rows. Output ``(mode, precision, recall, f1, runs)``."""
    counts, cached = None, False
    seeds = [base_seed + run for run in range(n_repeat)]
    for mode, train in train_sets:
        tr, te, feats = train, test, list(features)
        if pca_cols:
            tr, te = pc_feature(train, test, pca_cols)
            feats = ["PC", *[f for f in features if f not in pca_cols]]
        tr = tr.select(*feats, label_col)
        model = forest.training_cells(tr, feats, label_col, MAX_BINS)
        rows = te.select(*feats, F.col(endpoint_col).alias(endpoint_col), F.col(label_col).alias("truth"))
        said = model and forest.vote_on(model, rows, seeds, num_trees, max_depth)
        if said is None:
            test, cached = test.persist(), True
            parts = _scored_by_rows(tr, te, feats, label_col, seeds, num_trees, max_depth, endpoint_col, parallel_fits)
        else:
            scored = said.groupBy(endpoint_col, "truth", "_said").agg(F.count(F.lit(1)).alias("n"))
            scored = written(scored.repartition(endpoint_col), "scored")  # the counts of an endpoint meet in one task
            parts = [scored.select(endpoint_col, "truth", forest.said_label(model.labels, run).alias("prediction"), "n")
                     for run in range(n_repeat)]
        for run, part in enumerate(parts):
            part = part.withColumns({"mode": F.lit(mode), "run": F.lit(run)})
            counts = part if counts is None else counts.unionByName(part)
    per_run = precision_recall_f1(score_from_counts(counts, ["mode", "run"], endpoint_col))
    result = per_run.groupBy("mode").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                         F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("runs"))
    # one row per mode: collect it, then release the cached test set
    rows, schema = result.collect(), result.schema
    if cached:
        test.unpersist()
    return test.sparkSession.createDataFrame(rows, schema)


def _scored_by_rows(train: DataFrame, test: DataFrame, features: Sequence[str], label_col: str, seeds: Sequence[int],
                    num_trees: int, max_depth: int, endpoint_col: str, parallel_fits: int) -> list[DataFrame]:
    """Per seed the test rows as scored by its forest, fitted row by row. The
    training set is assembled once, shared by the fits and then released
    (fixed seeds keep the result independent of their order)."""
    from concurrent.futures import ThreadPoolExecutor

    assembled, labels = prepare_training(train, features, label_col)
    assembled = assembled.persist()
    with ThreadPoolExecutor(max_workers=max(1, parallel_fits)) as pool:
        models = list(pool.map(lambda seed: fit_forest(assembled, num_trees, max_depth, seed), seeds))
    assembled.unpersist()
    preds = [predict_forest(model, labels, test, features, keep=[endpoint_col, label_col]) for model in models]
    return [p.select(endpoint_col, F.col(label_col).alias("truth"), "prediction", F.lit(1).cast("bigint").alias("n")) for p in preds]
