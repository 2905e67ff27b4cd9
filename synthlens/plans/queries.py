"""Named queries over the driver's tables, one per operator of the
inventory. Each takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns match the SQL twin in ``synthlens.plans.oracle``.

Computed doubles are rounded to ten significant digits (``sig``) on both
sides so the comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.functions.numeric import round_binary
from synthlens.functions.text import reply_clean, reply_slice
from synthlens.operators import clean, detect, features, fidelity, profile, report, sampling, synth
from synthlens.operators.joins import written
from synthlens.plans import fixtures as fx
from synthlens.plans import workflows
from synthlens.session import scratch_dir
from synthlens.sources import files
from synthlens.sources.catalog import DatasetSpec, catalog_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATS = fx.FLOW_FEATURES
SEED = 42
SAMPLE_N = 1000
BATCH = 20
REQUEST = 15  # records asked of a reply, which holds up to 20
TOL = 1e-6
SKETCH_BOUND = 0.05  # six standard errors of the sketches

# Our descriptions of the lineitem columns used as session features.
FLOW_SPECS = [
    synth.FeatureSpec("l_quantity", "quantity", "units on the order line"),
    synth.FeatureSpec("l_extendedprice", "extended price", "quantity times unit price"),
    synth.FeatureSpec("l_discount", "discount", "fraction taken off the price"),
    synth.FeatureSpec("l_tax", "tax", "fraction added as tax"),
]


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def sig(c: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (zero normalised to +0.0)."""
    e = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), F.abs(e))
    back = F.when(e >= 0, round_binary(c / scale, digits - 1) * scale).otherwise(round_binary(c * scale, digits - 1) / scale)
    return (F.when(c.isNull(), F.lit(None).cast("double")).when(c == 0, F.lit(0.0))
            .when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(back))


def zero_norm(c: Column) -> Column:
    return c + F.lit(0.0)


def sig_cols(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: sig(F.col(c)) for c in cols})


def flows_real(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return f.where((F.col("grp") == "F") & (F.col("label") == "ssh"))


def flows_p(spark, sf_dir):
    return fx.flows(spark, sf_dir).where(F.col("grp") == "F")


def flows_q(spark, sf_dir):
    return fx.flows(spark, sf_dir).where(F.col("grp") == "O")


def real_profile(spark, sf_dir, quantiles=True):
    return profile.describe_profile(flows_real(spark, sf_dir), FEATS, quantiles=quantiles)


def baseline(spark, sf_dir, seed, noise):
    """Gaussian stand-in with as many rows as the real group; the row count
    comes from the same one-pass moments aggregate as the profile."""
    moments = profile.describe_profile(flows_real(spark, sf_dir), FEATS, quantiles=False)
    rows = moments.collect()
    n = max((r["n"] for r in rows), default=0)
    prof = spark.createDataFrame(rows, moments.schema)
    return synth.gaussian_baseline(spark, prof, FEATS, n, seed, noise)


# ---------------------------------------------------------------- sources


def _orders_sheet(spark, sf_dir, indexed):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderpriority")
    path = scratch_dir(spark, "orders-sheet")
    if indexed:
        o = o.withColumn("_row", F.col("o_orderkey"))
    return files.write_sheet(o, path, index_col="_row" if indexed else None)


@query("scan_csv_indexed")
def q_scan_csv_indexed(spark, sf_dir):
    path = _orders_sheet(spark, sf_dir, indexed=True)
    df = files.scan_features(spark, path, ["o_totalprice"], keep=["o_orderkey", "o_custkey", "o_orderstatus",
                                                                   "o_orderpriority"], indexed=True, fmt="csv")
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                     F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus", "o_orderpriority",
                     "o_totalprice")


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    path = _orders_sheet(spark, sf_dir, indexed=False)
    df = files.scan_features(spark, path, ["o_totalprice"], keep=["o_orderkey", "o_orderstatus"], fmt="csv")
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice")


@query("scan_clean")
def q_scan_clean(spark, sf_dir):
    path = scratch_dir(spark, "dirty-sheet")
    files.write_sheet(fx.dirty(spark, sf_dir), path)
    df = files.scan_clean(spark, path, ["value"], fmt="csv")
    return df.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
                     "event_type", "value")


FLOWS_SPEC = DatasetSpec(name="flows", real_dir="lineitem", fake_dir="", train_file="grp=F",
                         test_files={"test": "grp=O"}, features=tuple(FEATS), label_col="label")


@query("dataset_catalog")
def q_dataset_catalog(spark, sf_dir):
    cat = catalog_frame(spark, [FLOWS_SPEC])
    sizes = fx.flows(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.select(F.concat(F.lit("grp="), F.col("grp")).alias("file"), "n_rows")
    return cat.join(sizes, "file", "left").select("dataset", "split", "dir", "file", "n_features", "label_col",
                                                  F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


@query("first_available_source")
def q_first_available_source(spark, sf_dir):
    """Once with a file at the second place, once with no file at all."""
    path = _orders_sheet(spark, sf_dir, indexed=False)
    def load(candidates):
        chosen = files.first_available(spark, candidates)
        if chosen is None:
            df = fx.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
            return df.select(F.lit(0).alias("chosen"), F.lit(1).alias("fallback"), "o_orderkey", "o_totalprice")
        df = files.scan_features(spark, chosen, ["o_totalprice"], keep=["o_orderkey"], fmt="csv")
        return df.select(F.lit(candidates.index(chosen) + 1).alias("chosen"), F.lit(0).alias("fallback"),
                         F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice")

    return load([path + "-missing-1", path, path + "-missing-2"]).unionByName(load([path + "-missing-1"]))


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    path = files.write_sheet(fx.flows(spark, sf_dir), scratch_dir(spark, "flows-sheet"))
    return files.scan_features(spark, path, FEATS, keep=["grp", "label"], fmt="csv")


def _reply_plan(spark, sf_dir):
    n = fx.table(spark, sf_dir, "events").count()
    return synth.batch_plan(spark, n, BATCH), n


@query("completion_source")
def q_completion_source(spark, sf_dir):
    plan, _ = _reply_plan(spark, sf_dir)
    recorded = fx.responses(spark, sf_dir).where(F.col("batch") % 9 != 0)
    out = synth.completion_source(plan, recorded=recorded)
    return out.select("batch", "request_n", "response", F.col("response").isNotNull().cast("int").alias("has_reply"),
                      "error")


def _report_tables(spark, sf_dir):
    points = written(q_embedding_2d(spark, sf_dir), "report-points")
    return {
        "jsd": fidelity.pair_jsd(flows_pair(spark, sf_dir), FEATS),
        "histogram": fidelity.pair_histogram(flows_pair(spark, sf_dir), FEATS),
        "box": fidelity.box_stats(fx.flows(spark, sf_dir), FEATS, "grp"),
        "hexbin": fidelity.hexbin_density(points, "x", "y", "grp"),
        "scatter": points,
        "load_audit": q_load_audit(spark, sf_dir),
    }


@query("report_tables")
def q_report_tables(spark, sf_dir):
    out = report.write_report_tables(_report_tables(spark, sf_dir), scratch_dir(spark, "report"))
    return out.select(F.col("table").alias("report"), F.col("rows").alias("n_rows"))


@query("load_audit")
def q_load_audit(spark, sf_dir):
    """Two sources whose quantity is unknown in some rows, and a stand-in."""
    f = fx.flows(spark, sf_dir).withColumn("l_quantity", F.when(F.col("l_tax") >= 0.02, F.col("l_quantity")))
    parts = [report.load_audited(g, f.where(F.col("grp") == g), F.col("label") == "ssh", FEATS,
                                 scratch_dir(spark, "load"), False, SAMPLE_N)[1] for g in ("F", "O")]
    stand_in = report.load_audited("baseline", baseline(spark, sf_dir, SEED + 1, 1.03), None, FEATS,
                                   scratch_dir(spark, "load"), True)[1]
    out = parts[0].unionByName(parts[1]).unionByName(stand_in)
    return out.withColumn("simulated", F.col("simulated").cast("int"))


@query("load_synthetic_a")
def q_load_synthetic_a(spark, sf_dir):
    """The loader of source A on a sheet with an index column, a label
    column by its second name, fractions, holes, and one feature absent."""
    f = fx.flows(spark, sf_dir)
    quantity = F.when(F.col("l_tax") >= 0.02, F.col("l_quantity") / 100.0).alias("l_quantity")
    sheet = f.select("grp", F.col("label").alias("LABEL"), quantity, "l_discount", "l_tax")
    path = files.write_sheet(sheet, scratch_dir(spark, "synthetic-a"))
    return sig_cols(workflows.load_synthetic_a(spark, path, FEATS, f.count(), SEED), FEATS)


# ---------------------------------------------------------------- projections, filters


@query("feature_projection")
def q_feature_projection(spark, sf_dir):
    return clean.project_features(fx.flows(spark, sf_dir), FEATS)


@query("label_filter_exact")
def q_label_filter_exact(spark, sf_dir):
    return clean.label_filter(fx.flows(spark, sf_dir), "label", "ssh")


def _mixed_case(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    lab = (F.when(F.col("l_returnflag") == "R", "SSH").when(F.col("l_returnflag") == "A", "Ssh")
           .otherwise("non-ssh"))
    return li.select(lab.alias("label"), *FEATS)


@query("label_filter_ci")
def q_label_filter_ci(spark, sf_dir):
    return clean.label_filter(_mixed_case(spark, sf_dir), "label", "ssh", case_insensitive=True)


@query("label_column_resolve")
def q_label_column_resolve(spark, sf_dir):
    f = fx.flows(spark, sf_dir).withColumn("status_label", F.when(F.col("grp") == "F", "ssh").otherwise("non-ssh"))
    return clean.filter_by_resolved_label(f, ["LABEL with GAP and Softmax", "status_label", "label"])


@query("drop_incomplete")
def q_drop_incomplete(spark, sf_dir):
    return clean.drop_incomplete(clean.inf_to_null(fx.dirty(spark, sf_dir), ["value"]))


@query("drop_incomplete_subset")
def q_drop_incomplete_subset(spark, sf_dir):
    return clean.drop_incomplete(fx.dirty(spark, sf_dir), ["value"])


@query("inf_to_null")
def q_inf_to_null(spark, sf_dir):
    return clean.inf_to_null(fx.dirty(spark, sf_dir), ["value"]).select("event_id", "value")


@query("fill_missing_features")
def q_fill_missing_features(spark, sf_dir):
    f = fx.flows(spark, sf_dir).drop("l_tax")
    return clean.fill_missing_features(f, FEATS).select("grp", "label", *FEATS)


@query("default_endpoint")
def q_default_endpoint(spark, sf_dir):
    real = clean.default_endpoint(flows_p(spark, sf_dir), *clean.REAL_ENDPOINT)
    syn = clean.mark_synthetic(flows_q(spark, sf_dir), "label")
    cols = ["grp", "label", clean.DEST_COL, clean.PORT_COL]
    return real.select(*cols).unionByName(syn.select(*cols))


@query("auto_rescale")
def q_auto_rescale(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    small = clean.auto_rescale(f.select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b")), ["a", "b"])
    large = clean.auto_rescale(f.select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b")), ["a", "b"])
    out = small.withColumn("part", F.lit("small")).unionByName(large.withColumn("part", F.lit("large")))
    return sig_cols(out.select("part", "a", "b"), ["a", "b"])


@query("clip_to_profile")
def q_clip_to_profile(spark, sf_dir):
    prof = real_profile(spark, sf_dir, quantiles=False)
    target = fx.flows(spark, sf_dir).select("grp", *[(F.col(f) * 1.2).alias(f) for f in FEATS])
    return sig_cols(clean.clip_to_profile(target, prof, FEATS), FEATS)


@query("endpoint_key")
def q_endpoint_key(spark, sf_dir):
    p = fx.preds(spark, sf_dir)
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    p = p.join(o, "o_orderkey").withColumn(clean.DEST_COL, F.when(F.col("o_orderstatus") == "P", F.lit(None))
                                           .otherwise(F.col(clean.DEST_COL)))
    return clean.endpoint_key(p).select("o_orderkey", "endpoint")


@query("cast_features")
def q_cast_features(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("v"),
                                                  F.col("event_type").alias("t"))
    return clean.cast_features(ev, ["v", "t"])


@query("required_feature_check")
def q_required_feature_check(spark, sf_dir):
    recs = synth.records_from_replies(fx.responses(spark, sf_dir), ["f1", "f2", "f3"])
    return clean.feature_presence(recs, ["f1", "f2", "f3"])


# ---------------------------------------------------------------- joins


@query("profile_join")
def q_profile_join(spark, sf_dir):
    prof = real_profile(spark, sf_dir, quantiles=False).select("feature", "mean", "std")
    rows = profile.unpivot_long(fx.flows(spark, sf_dir), FEATS, ["grp"])
    out = profile.profile_join(rows, prof)
    z = (F.col("x") - F.col("mean")) / F.col("std")
    return out.select("grp", "feature", "x", zero_norm(round_binary(z, 8)).alias("z"))


def _voted(spark, sf_dir):
    p = clean.endpoint_key(fx.preds(spark, sf_dir))
    return detect.majority_vote(p, "endpoint", "prediction")


@query("vote_join_back")
def q_vote_join_back(spark, sf_dir):
    return _voted(spark, sf_dir).select("o_orderkey", "endpoint", "truth", "prediction", "final")


@query("train_scalar_apply")
def q_train_scalar_apply(spark, sf_dir):
    out = detect.minmax_scale(flows_p(spark, sf_dir), flows_q(spark, sf_dir), "l_extendedprice", "scaled")
    return sig_cols(out.select("l_extendedprice", "scaled"), ["scaled"])


def flows_pair(spark, sf_dir):
    """Groups F (p) and O (q) of flows from one scan per pass."""
    return fidelity.pair_by_group(fx.flows(spark, sf_dir), "grp", "F", "O", FEATS)


@query("histogram_align")
def q_histogram_align(spark, sf_dir):
    out = fidelity.pair_align(flows_pair(spark, sf_dir), FEATS)
    return sig_cols(out, ["lo_edge", "hi_edge"])


@query("metric_pivot")
def q_metric_pivot(spark, sf_dir):
    m = profile.group_moments(fx.flows(spark, sf_dir), FEATS, "grp")
    return sig_cols(profile.metric_pivot(m, "mean", "grp", ["F", "O"], ["mean_f", "mean_o"]), ["mean_f", "mean_o"])


# ---------------------------------------------------------------- aggregates


@query("describe_profile")
def q_describe_profile(spark, sf_dir):
    out = profile.describe_profile(fx.flows(spark, sf_dir), FEATS, ["grp"])
    return sig_cols(out, ["mean", "std", "min_v", "q1", "q2", "q3", "max_v"])


@query("group_means")
def q_group_means(spark, sf_dir):
    m = profile.group_moments(fx.flows(spark, sf_dir), FEATS, "grp")
    return sig_cols(m.select("grp", "feature", "mean"), ["mean"])


@query("group_stds")
def q_group_stds(spark, sf_dir):
    m = profile.group_moments(fx.flows(spark, sf_dir), FEATS, "grp")
    return sig_cols(m.select("grp", "feature", "std"), ["std"])


@query("covariance_matrix")
def q_covariance_matrix(spark, sf_dir):
    return sig_cols(profile.covariance_matrix(flows_p(spark, sf_dir), FEATS), ["cov"])


@query("joint_range")
def q_joint_range(spark, sf_dir):
    out = fidelity.pair_ranges(flows_pair(spark, sf_dir), FEATS)
    return sig_cols(out.select("feature", "lo", "hi"), ["lo", "hi"])


@query("feature_histogram")
def q_feature_histogram(spark, sf_dir):
    return fidelity.pair_histogram(flows_pair(spark, sf_dir), FEATS)


@query("jsd")
def q_jsd(spark, sf_dir):
    return fidelity.pair_jsd(flows_pair(spark, sf_dir), FEATS)


@query("jsd_summary")
def q_jsd_summary(spark, sf_dir):
    """Real sessions against the other group, and against the stand-in, which is generated once."""
    ssh = fx.flows(spark, sf_dir).where(F.col("label") == "ssh").select("grp", *FEATS)
    made = written(baseline(spark, sf_dir, SEED + 2, 1.08).select(F.lit("made").alias("grp"), *FEATS), "stand-in")
    grp = F.col("grp")
    pairs = [("jsd_a", grp == "F", grp == "O"), ("jsd_b", grp == "F", grp == "made")]
    return sig_cols(fidelity.compare_jsd(fidelity.pairs_jsd(ssh.unionByName(made), pairs, FEATS)), ["jsd_a", "jsd_b"])


@query("majority_vote")
def q_majority_vote(spark, sf_dir):
    return detect.endpoint_votes(clean.endpoint_key(fx.preds(spark, sf_dir)), "endpoint", "prediction")


@query("confusion_counts")
def q_confusion_counts(spark, sf_dir):
    return detect.confusion_counts(_voted(spark, sf_dir), "truth", "final")


@query("precision_recall_f1")
def q_precision_recall_f1(spark, sf_dir):
    out = detect.precision_recall_f1(detect.confusion_counts(_voted(spark, sf_dir), "truth", "final"))
    return sig_cols(out.select("tp", "fp", "fn", "precision", "recall", "f1"), ["precision", "recall", "f1"])


@query("repeat_average")
def q_repeat_average(spark, sf_dir):
    p = clean.endpoint_key(fx.preds(spark, sf_dir)).withColumn("run", F.year("o_orderdate"))
    a = p.withColumn("mode", F.lit("high"))
    b = p.withColumn("mode", F.lit("urgent")).withColumn(
        "prediction", F.when(F.col("o_orderpriority") == "1-URGENT", "ssh").otherwise("non-ssh"))
    key = F.concat_ws("|", "mode", F.col("run").cast("string"), "endpoint")
    both = a.unionByName(b).withColumn("_ep", F.when(F.col("endpoint") == detect.DUMMY_ENDPOINT, F.col("endpoint"))
                                       .otherwise(key))
    voted = detect.majority_vote(both, "_ep", "prediction")
    out = detect.repeat_average(voted)
    return sig_cols(out, ["precision", "recall", "f1"])


@query("box_stats")
def q_box_stats(spark, sf_dir):
    out = fidelity.box_stats(fx.flows(spark, sf_dir), FEATS, "grp")
    return sig_cols(out, ["q1", "med", "q3", "whislo", "whishi"])


@query("hexbin_density")
def q_hexbin_density(spark, sf_dir):
    """Cells of the embedded points."""
    return fidelity.hexbin_density(q_embedding_2d(spark, sf_dir), "x", "y", "grp")


@query("group_counts")
def q_group_counts(spark, sf_dir):
    return profile.group_counts(fx.flows(spark, sf_dir), "grp")


def _items(spark, sf_dir):
    """Parsed replies, written once per query and shared."""
    items = synth.parsed_items(fx.responses(spark, sf_dir))
    path = scratch_dir(spark, "reply-items")
    items.write.parquet(path)
    return spark.read.schema(items.schema).parquet(path)


def _runs(spark, sf_dir):
    """Two runs that ask for fewer records than a reply holds: ``all``
    replies, of which some fail, so that the target is missed; the ``full``
    ones, which reach it, the last with a smaller request and some unread.
    (run, items, n)."""
    items = _items(spark, sf_dir)
    events = fx.table(spark, sf_dir, "events").count()
    full = items.where(F.col("batch") % 6 < 3).withColumn("batch", fx.full_number(F.col("batch")))
    return [("all", items, events * REQUEST // fx.REPLY_BATCH), ("full", full, events * 3 // 10 - 7)]


def _accountings(spark, sf_dir):
    return [(run, items, synth.batch_accounting(synth.counts_from_items(items), n, REQUEST))
            for run, items, n in _runs(spark, sf_dir)]


def _per_run(frames):
    (run_a, a), (run_b, b) = frames
    return a.withColumn("run", F.lit(run_a)).unionByName(b.withColumn("run", F.lit(run_b)))


@query("batch_outcomes")
def q_batch_outcomes(spark, sf_dir):
    return _per_run([(run, synth.batch_outcomes(acc)) for run, _, acc in _accountings(spark, sf_dir)])


# ---------------------------------------------------------------- windows, samples, unions


@query("batch_accounting")
def q_batch_accounting(spark, sf_dir):
    return _per_run([(run, acc) for run, _, acc in _accountings(spark, sf_dir)])


def _take_first(spark, sf_dir, feats=fx.REPLY_FEATURES):
    return [(run, synth.take_first_per_batch(synth.records_from_items(items, feats), acc))
            for run, items, acc in _accountings(spark, sf_dir)]


@query("take_first_per_batch")
def q_take_first_per_batch(spark, sf_dir):
    return _per_run(_take_first(spark, sf_dir))


@query("ipa_gaps")
def q_ipa_gaps(spark, sf_dir):
    g = features.ipa_gaps(fx.packets(spark, sf_dir), "session", "ts", "pid")
    return sig_cols(g.select("session", "pid", "gap"), ["gap"])


def _sample_base(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("exact_sample")
def q_exact_sample(spark, sf_dir):
    return sampling.exact_sample(_sample_base(spark, sf_dir), SAMPLE_N, SEED, key_cols=["o_orderkey"])


@query("exact_sample_repeated")
def q_exact_sample_repeated(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    rows = li.select(*[F.round(F.col(c).cast("double") * 100).cast("bigint").alias(c) for c in ("l_discount", "l_tax")])
    return sampling.exact_sample(rows, SAMPLE_N, SEED)


@query("sample_sentinel")
def q_sample_sentinel(spark, sf_dir):
    base = _sample_base(spark, sf_dir)
    parts = [sampling.sample_sentinel(base, n, SEED, ["o_orderkey"]).withColumn("mode", F.lit(tag))
             for n, tag in ((-1, "all"), (0, "none"), (300, "n300"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("mode", "o_orderkey", "o_totalprice")


@query("cap_rows")
def q_cap_rows(spark, sf_dir):
    f = flows_real(spark, sf_dir).select(*FEATS)
    keyed = f.withColumns({f"_k{i}": F.round(F.col(c) * 100).cast("bigint") for i, c in enumerate(FEATS)})
    out = sampling.cap_rows(keyed, SAMPLE_N, SEED, key_cols=[f"_k{i}" for i in range(len(FEATS))])
    return out.select(*FEATS)


@query("augment_union")
def q_augment_union(spark, sf_dir):
    real = clean.default_endpoint(flows_p(spark, sf_dir), *clean.REAL_ENDPOINT)
    syn = clean.mark_synthetic(baseline(spark, sf_dir, SEED + 1, 1.03).drop("id"), "label")
    out = detect.augment_union(real, syn)
    return sig_cols(out.select("grp", "label", *FEATS, clean.DEST_COL, clean.PORT_COL), FEATS)


@query("labelled_union")
def q_labelled_union(spark, sf_dir):
    parts = [("real", flows_real(spark, sf_dir)), ("other", flows_q(spark, sf_dir)),
             ("baseline", baseline(spark, sf_dir, SEED + 1, 1.03))]
    return sig_cols(fidelity.labelled_union(parts, FEATS), FEATS)


# ---------------------------------------------------------------- scalar functions, synthesis


@query("reply_clean")
def q_reply_clean(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("batch", reply_clean(F.col("response")).alias("cleaned"))


@query("reply_slice")
def q_reply_slice(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("batch", reply_slice(reply_clean(F.col("response"))).alias("sliced"))


@query("reply_parse")
def q_reply_parse(spark, sf_dir):
    return synth.records_from_replies(fx.responses(spark, sf_dir), fx.REPLY_FEATURES)


def _flow_plan(spark, sf_dir):
    n = flows_real(spark, sf_dir).count()
    return synth.batch_plan(spark, n, BATCH)


@query("batch_plan")
def q_batch_plan(spark, sf_dir):
    return _flow_plan(spark, sf_dir)


@query("prompt_text")
def q_prompt_text(spark, sf_dir):
    return synth.prompt_text(real_profile(spark, sf_dir), FLOW_SPECS, _flow_plan(spark, sf_dir))


def _reply_profile(spark, sf_dir):
    return profile.describe_profile(fx.real_reply_rows(spark, sf_dir), fx.REPLY_FEATURES, quantiles=False)


@query("assemble_synthetic")
def q_assemble_synthetic(spark, sf_dir):
    """A cap below the number of complete records."""
    n = fx.table(spark, sf_dir, "events").count() // 4
    records = dict(_take_first(spark, sf_dir))["all"]
    return synth.assemble_synthetic(records, _reply_profile(spark, sf_dir), fx.REPLY_FEATURES, n)


@query("gaussian_baseline")
def q_gaussian_baseline(spark, sf_dir):
    return sig_cols(baseline(spark, sf_dir, SEED + 1, 1.03), FEATS)


@query("record_audit")
def q_record_audit(spark, sf_dir):
    return synth.record_audit(dict(_take_first(spark, sf_dir))["all"], _reply_profile(spark, sf_dir), fx.REPLY_FEATURES)


@query("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    p = flows_p(spark, sf_dir)
    out = detect.minmax_scale(p, p, "l_quantity", "scaled")
    return sig_cols(out.select("l_quantity", "scaled"), ["scaled"])


# ---------------------------------------------------------------- statistics and learning


@query("pc_feature")
def q_pc_feature(spark, sf_dir):
    tr, te = detect.pc_feature(flows_p(spark, sf_dir), flows_q(spark, sf_dir), FEATS)
    out = tr.select("grp", *FEATS, "PC").unionByName(te.select("grp", *FEATS, "PC"))
    return out.withColumn("PC", sig(F.col("PC"), 7))


@query("standardize")
def q_standardize(spark, sf_dir):
    z = fidelity.standardize(fx.flows(spark, sf_dir), FEATS).select("grp", *FEATS)
    return z.withColumns({f: zero_norm(round_binary(F.col(f), 8)) for f in FEATS})


@query("embedding_2d")
def q_embedding_2d(spark, sf_dir):
    parts = [("real", flows_real(spark, sf_dir)), ("other", flows_q(spark, sf_dir).where(F.col("label") == "ssh")),
             ("baseline", baseline(spark, sf_dir, SEED + 1, 1.03))]
    union = written(fidelity.labelled_union(parts, FEATS), "embedding-input")  # read for the axes and for the points
    out = fidelity.embedding_2d(union, FEATS, keep=["grp"])
    return out.withColumns({c: zero_norm(round_binary(F.col(c), 6)) for c in ("x", "y")})


@query("rf_predict")
def q_rf_predict(spark, sf_dir):
    f = fx.flows(spark, sf_dir).withColumn("label", F.when(F.col("l_quantity") > 25, "ssh").otherwise("non-ssh"))
    tr, te = f.where(F.col("grp") == "F"), f.where(F.col("grp") == "O")
    out = detect.rf_predict(tr, te, FEATS, "label", num_trees=100, seed=SEED)
    return out.select("label", "prediction")


def _experiment_sets(spark, sf_dir):
    """The label follows the quantity, the endpoints (ports of a supplier)
    hold rows of both labels, and the synthetic rows have whole quantities of
    the ssh range, so a forest can learn the rule and the vote changes rows."""
    li = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("grp"),
        F.when(F.col("l_quantity") > 25, "ssh").otherwise("non-ssh").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in FEATS],
        F.col("l_suppkey").cast("string").alias(clean.DEST_COL), F.col("l_linenumber").alias(clean.PORT_COL))
    real = li.where(F.col("grp") == "F")
    test = clean.endpoint_key(li.where(F.col("grp") == "O"))
    sets = [("original", clean.endpoint_key(real))]
    ssh = real.where(F.col("label") == "ssh")
    moments = profile.describe_profile(ssh, FEATS, quantiles=False)
    rows = moments.collect()
    prof = spark.createDataFrame(rows, moments.schema)
    n = max((r["n"] for r in rows), default=0)
    for name, seed, noise in (("baseline_a", SEED + 1, 1.03), ("baseline_b", SEED + 2, 1.08)):
        syn = synth.gaussian_baseline(spark, prof, FEATS, n, seed, noise).drop("id")
        syn = syn.withColumns({f: F.round(F.col(f)) for f in ("l_quantity", "l_extendedprice")})
        syn = clean.mark_synthetic(written(syn, "baseline"), "label")  # drawn once, read by every pass of its mode
        sets.append((name, clean.endpoint_key(detect.augment_union(real, syn))))
    return sets, test


@query("detection_experiment")
def q_detection_experiment(spark, sf_dir):
    sets, test = _experiment_sets(spark, sf_dir)
    out = detect.detection_experiment(sets, test, FEATS, "label", pca_cols=["l_discount", "l_tax"],
                                      n_repeat=10, num_trees=100)
    return sig_cols(out, ["precision", "recall", "f1"])


@query("feature_correlation")
def q_feature_correlation(spark, sf_dir):
    out = profile.feature_correlation(fx.flows(spark, sf_dir), "l_quantity", "l_extendedprice", "grp")
    return sig_cols(out, ["corr"])


# ---------------------------------------------------------------- session features


def _pk(spark, sf_dir):
    return fx.packets(spark, sf_dir)


@query("connection_stats")
def q_connection_stats(spark, sf_dir):
    return sig_cols(features.connection_stats(fx.conns(spark, sf_dir), "dst", "src"), ["avg_per_source"])


@query("connection_sketches")
def q_connection_sketches(spark, sf_dir):
    """Sketches per destination and month, written, united per destination,
    and held against the exact count within ``SKETCH_BOUND``."""
    conns = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("src"), F.col("l_shipdate"))
    kept = written(features.connection_sketches(conns, "dst", "src", F.date_format("l_shipdate", "yyyy-MM")), "sketches")
    guessed = features.stats_from_sketches(kept, "dst").select("dst", "total", F.col("n_sources").alias("_guess"))
    exact = features.connection_stats(conns, "dst", "src").select("dst", "n_sources")
    off = F.abs(F.col("_guess") - F.col("n_sources"))
    return guessed.join(exact, "dst").select(
        "dst", "total", "n_sources", (off <= F.col("n_sources") * SKETCH_BOUND).cast("int").alias("within"))


def _transfer(spark, sf_dir):
    return features.transfer_stats(_pk(spark, sf_dir), "session", "ts", "bytes", F.col("sent"))


@query("transfer_stats")
def q_transfer_stats(spark, sf_dir):
    return sig_cols(_transfer(spark, sf_dir), ["bytes_sent", "bytes_recv", "duration", "ratio", "speed"])


@query("ipa_stats")
def q_ipa_stats(spark, sf_dir):
    return sig_cols(features.ipa_stats(_pk(spark, sf_dir), "session", "ts", "pid"), ["ipa_mean", "ipa_var"])


@query("session_time")
def q_session_time(spark, sf_dir):
    out = features.session_time(_pk(spark, sf_dir), "session", "ts", "pid")
    ok = (F.col("residual") <= F.lit(TOL) * F.greatest(F.lit(1.0), F.col("duration"))).cast("int")
    out = out.withColumn("residual_ok", ok)
    return sig_cols(out.select("session", "n_packets", "duration", "ipa_mean", "residual_ok"), ["duration", "ipa_mean"])


@query("log_scale")
def q_log_scale(spark, sf_dir):
    cs = features.connection_stats(fx.conns(spark, sf_dir), "dst", "src")
    cols = ["total", "n_sources", "avg_per_source"]
    return sig_cols(features.log_scale(cs, cols).select("dst", *cols), cols)


@query("session_type")
def q_session_type(spark, sf_dir):
    out = features.session_type(_transfer(spark, sf_dir))
    return sig_cols(out.select("session", "ratio", "session_type"), ["ratio"])


@query("coherence_audit")
def q_coherence_audit(spark, sf_dir):
    """Stated values of which some are wrong: each rule has its own keys."""
    def wrong(col, key, every, times):
        return (F.col(col) * F.when(F.col(key) % every == 0, times).otherwise(1.0)).alias(col)

    cs = features.connection_stats(fx.conns(spark, sf_dir), "dst", "src")
    cs = cs.select("dst", "total", "n_sources", wrong("avg_per_source", "dst", 10, 1.5))
    gaps = features.packet_gaps(_pk(spark, sf_dir), "session", "ts", "pid")
    st = features.stats_of_gaps(gaps, "session").drop("duration")
    sessions = _transfer(spark, sf_dir).join(st, "session").select(
        "session", "bytes_sent", "bytes_recv", "duration", "n_packets", wrong("speed", "session", 7, 2.0),
        wrong("ratio", "session", 11, 1.5), wrong("ipa_mean", "session", 13, 1.1), wrong("ipa_var", "session", 5, 2.0))
    return features.coherence_audit(cs, sessions, TOL, gaps)
