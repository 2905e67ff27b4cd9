"""The three end-to-end runs, composed from the operators.

- ``synthesize``           real records -> profile -> prompts -> replies ->
                           accepted, clipped synthetic records (+ outcomes)
- ``fidelity_report``      real vs two synthetic sources (or Gaussian
                           stand-ins): JSD, box statistics, means/stds,
                           2-D embedding and its hex density, load audit
- ``detector_comparison``  forests trained on real / real + synthetic rows,
                           voted per destination, precision/recall/F1 per mode

Every step is a DataFrame; the only driver-side values are constant-size
(row counts, a covariance matrix, quantile brackets).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.operators import clean, detect, fidelity, profile, report, sampling, synth
from synthlens.session import scratch_dir
from synthlens.sources import files
from synthlens.sources.catalog import SESSION_FEATURES, DatasetSpec

# Label-column candidates of the two synthetic sources, and
# the four key features of the box-statistics panel (``box_features`` of the session tables).
REPORT_A_LABELS = ("LABEL with GAP and Softmax", "LABEL")
DETECTOR_SYNTH_LABELS = ("label", "LABEL")
BOX_FEATURES = ("log_time_interval_mean", "log_time_interval_var", "log_ratio_trans_receive", "log_time_taken")

# What the operators of ``operators.features`` compute for each session feature.
_BUILT_BY = {
    "connection_stats": {"log_count_total_connect": "all connections to the destination",
                         "log_count_connect_IP": "different sources that reach the destination",
                         "log_avg_count_connect": "connections to the destination per different source"},
    "transfer_stats": {"log_cs_byte": "total of the bytes sent",
                       "log_transmit_speed_BPS": "bytes sent per second of the session",
                       "log_ratio_trans_receive": "bytes sent for every byte received"},
    "session_time": {"log_time_taken": "seconds from the first packet to the last"},
    "ipa_stats": {"log_time_interval_mean": "average pause between two packets",
                  "log_time_interval_var": "variance of the pauses between packets"},
}


def _spec(key: str) -> synth.FeatureSpec:
    """Name and description of a session feature for the prompt, from its key."""
    name = key.removeprefix("log_").replace("_", " ")
    text = next(texts[key] for texts in _BUILT_BY.values() if key in texts)
    return synth.FeatureSpec(key, f"{name}, on a log scale", text)


SESSION_SPECS = [_spec(key) for key in SESSION_FEATURES]


def load_real(spark: SparkSession, path: str, features: Sequence[str], n: int | None, seed: int = 42,
              label_col: str = "LABEL", label: str = clean.SSH, indexed: bool = True) -> DataFrame:
    """Real records: scan, exact label filter, feature projection, drop
    incomplete, exact sample of ``n`` (None: all)."""
    df = files.scan_features(spark, path, features, keep=[label_col], indexed=indexed)
    df = clean.drop_incomplete(clean.label_filter(df, label_col, label).select(*features), features)
    return df if n is None else sampling.exact_sample(df, n, seed)


def synthesize(spark: SparkSession, real: DataFrame, features: Sequence[str] = SESSION_FEATURES,
               specs: Sequence[synth.FeatureSpec] = tuple(SESSION_SPECS), n: int = 1000, batch_size: int = 20,
               recorded: DataFrame | None = None, completer: Callable[[str, str], str] | None = None,
               seed: int = 42, label_col: str | None = None, output_path: str | None = None,
               concurrency: int | None = None,
               replies_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Synthesis run. Returns ``(records, outcomes, prompts)``.

    Prompts are rendered for the static plan; replies come from a recorded
    table or from ``completer`` run in the executors. Acceptance follows the
    sequential rule (closed form), so the records equal a one-by-one run.
    With ``replies_path`` the replies are kept there: a run that ended is
    started again by the same call and asks only the batches without one.
    """
    prof = profile.describe_profile(real, features).persist()
    plan = synth.batch_plan(spark, n, batch_size)
    prompts = synth.prompt_text(prof, specs, plan)
    if recorded is not None:
        replies = synth.completion_source(prompts, recorded=recorded)
    else:  # written: a second call would give other texts
        replies = synth.resumed_replies(prompts, completer, replies_path or scratch_dir(spark, "replies"),
                                        concurrency=concurrency)
    items = synth.parsed_items(replies)
    acc = synth.batch_accounting(synth.counts_from_items(items), n, batch_size)
    recs = synth.take_first_per_batch(synth.records_from_items(items, features), acc)
    out = synth.assemble_synthetic(recs, prof, features, n, seed, label_col=label_col)
    if output_path:
        files.write_sheet(out.select(*features, *([label_col] if label_col else [])), output_path)
    return out, synth.batch_outcomes(acc), prompts


def load_synthetic_a(spark: SparkSession, path: str, features: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Source A: the first column (an index) goes, ``ssh`` rows by the first
    label column there is, the features there are, complete rows, fractions
    to percent, an exact sample of ``n``, and 0 for an absent feature."""
    return clean_synthetic_a(files.read_table(spark, path), features, n, seed)


def clean_synthetic_a(df: DataFrame, features: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``load_synthetic_a`` of a table that is already read."""
    df = df.drop(df.columns[0])
    df = clean.filter_by_resolved_label(df, REPORT_A_LABELS)
    avail = [f for f in features if f in df.columns]
    df = clean.drop_incomplete(clean.cast_features(df.select(*avail), avail), avail)
    df = clean.auto_rescale(df, avail)
    df = sampling.exact_sample(df, n, seed)
    return clean.fill_missing_features(df, features).select(*features)


def load_synthetic_b(spark: SparkSession, path: str, features: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Source B: every feature must be there; complete rows, exact sample."""
    return clean_synthetic_b(files.read_table(spark, path), features, n, seed)


def clean_synthetic_b(df: DataFrame, features: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``load_synthetic_b`` of a table that is already read."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"features missing from source B: {absent}")
    df = clean.cast_features(df.select(*features), features)
    return sampling.exact_sample(clean.drop_incomplete(df, features), n, seed)


def _audited(spark: SparkSession, name: str, path: str, labels: Sequence[str], features: Sequence[str],
             n: int) -> tuple[DataFrame, DataFrame]:
    raw = files.read_table(spark, path)
    col = clean.resolve_label_column(raw, labels)
    have = [f for f in features if f in raw.columns]
    ok = None if col is None else F.col(col).cast("string") == clean.SSH
    return report.load_audited(name, clean.cast_features(raw, have), ok, have, scratch_dir(spark, "load"), False, n)


def fidelity_report(spark: SparkSession, original: DataFrame, a_path: str | None = None, b_path: str | None = None,
                    features: Sequence[str] = SESSION_FEATURES, n: int = 1000, seed: int = 42,
                    box_features: Sequence[str] | None = None, out_dir: str | None = None) -> dict[str, DataFrame]:
    """Fidelity report of ``original`` (already loaded and sampled; named
    features are the box panel's, by default all of them) against
    synthetic source A and B; an absent file is replaced by a Gaussian
    stand-in of ``n`` rows from the original's profile (noise 1.03 / 1.08,
    seeds +1 / +2).
    Every source is written once as it is loaded, and audited by the tasks
    that write it. Returns named report tables (and writes them under
    ``out_dir``)."""
    def load(name: str, df: DataFrame, stand_in: bool) -> tuple[DataFrame, DataFrame]:
        return report.load_audited(name, df, None, features, scratch_dir(spark, "load"), stand_in)

    original, audit = load("original", original, False)
    base_prof = profile.describe_profile(original, features, quantiles=False).persist()
    sim, audits, noisy = {}, [audit], []
    if a_path and files.path_exists(spark, a_path):
        raw, audit = _audited(spark, "A", a_path, REPORT_A_LABELS, features, n)
        a, sim["A"] = clean_synthetic_a(raw, features, n, seed), False
        audits.append(audit)
    else:
        a, audit = load("A", synth.gaussian_baseline(spark, base_prof, features, n, seed + 1, 1.03).drop("id"), True)
        sim["A"] = True
        noisy.append(audit)
    if b_path and files.path_exists(spark, b_path):
        raw, audit = _audited(spark, "B", b_path, (), features, n)
        b, sim["B"] = clean_synthetic_b(raw, features, n, seed), False
        audits.append(audit)
    else:
        b, audit = load("B", synth.gaussian_baseline(spark, base_prof, features, n, seed + 2, 1.08).drop("id"), True)
        sim["B"] = True
        noisy.append(audit)
    audits += noisy
    union = fidelity.labelled_union([("original", original), ("A", a), ("B", b)], features).persist()
    emb = fidelity.embedding_2d(union, features, keep=["grp"])
    grp = F.col("grp")
    pairs = [("jsd_a", grp == "original", grp == "A"), ("jsd_b", grp == "original", grp == "B")]
    moments = profile.group_moments(union, features, "grp")
    tables = {
        "jsd": fidelity.compare_jsd(fidelity.pairs_jsd(union, pairs, features)),
        "means": profile.metric_pivot(moments, "mean", "grp", ["original", "A", "B"]),
        "stds": profile.metric_pivot(moments, "std", "grp", ["original", "A", "B"]),
        "box": fidelity.box_stats(union, list(box_features or features), "grp"),
        "embedding": emb,
        "hexbin": fidelity.hexbin_density(emb, "x", "y", "grp"),
        "counts": profile.group_counts(union, "grp"),
        "load_audit": reduce(DataFrame.unionByName, audits),
        "provenance": spark.createDataFrame([(k, v) for k, v in sim.items()], "source string, simulated boolean"),
    }
    if out_dir:
        report.write_report_tables(tables, out_dir)
    return tables


def _endpoint_ready(df: DataFrame, default: tuple[str, int]) -> DataFrame:
    return clean.endpoint_key(clean.default_endpoint(df, *default))


def detector_comparison(spark: SparkSession, spec: DatasetSpec, root: str, test_split: str, n_repeat: int = 10,
                        n_fake_ssh: int = -1, modes: Sequence[str] = ("original", "wgan_gp", "llm"),
                        num_trees: int = 100, max_depth: int = detect.MAX_DEPTH, seed: int = 42) -> DataFrame:
    """Detector experiment: one row per mode with mean precision, recall
    and F1 over ``n_repeat`` forests (seed = base + run)."""
    feats = list(spec.features)
    test = _endpoint_ready(files.scan_clean(spark, spec.test_path(root, test_split), feats), clean.REAL_ENDPOINT)
    real = _endpoint_ready(files.scan_clean(spark, spec.train_path(root), feats), clean.REAL_ENDPOINT)
    sets = []
    for mode in modes:
        train = real
        if mode != "original":
            path = files.first_available(spark, spec.synthetic_candidates(root, mode))
            if path is not None and n_fake_ssh != 0:
                fake = files.read_table(spark, path)
                col = clean.resolve_label_column(fake, DETECTOR_SYNTH_LABELS)
                if col is not None:
                    fake = clean.label_filter(fake, col, clean.SSH, case_insensitive=True)
                    fake = sampling.sample_sentinel(fake, n_fake_ssh, seed)
                    fake = clean.cast_features(fake.drop(col), [f for f in feats if f in fake.columns])
                    fake = clean.endpoint_key(clean.mark_synthetic(fake, spec.label_col))
                    train = detect.augment_union(real, fake)
        sets.append((mode, train))
    model_cols = list(spec.model_cols or feats)
    base_cols = [c for c in model_cols if c != "PC"]
    return detect.detection_experiment(sets, test, base_cols, spec.label_col,
                                       pca_cols=list(spec.pca_cols) or None, n_repeat=n_repeat,
                                       num_trees=num_trees, max_depth=max_depth, base_seed=seed)
