"""Physical-plan properties the scale design relies on (read from the
executed plan text, as `.explain()` shows it)."""

import re

from synthlens.plans.queries import QUERIES


def plan_of(df):
    """Text of the final adaptive plan (without the initial-plan copy)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_jsd_scan_is_pruned_and_filtered(spark, sf_small):
    plan = plan_of(QUERIES["jsd"](spark, sf_small))
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    assert scans
    for sc in scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", sc).group(1)
        assert len(schema.split(",")) <= 5          # 4 features + the group column
        assert "l_linestatus" in re.search(r"PushedFilters: \[([^\]]*)\]", sc).group(1)


def test_vote_is_aggregate_plus_broadcast_not_window(spark, sf_small):
    plan = plan_of(QUERIES["vote_join_back"](spark, sf_small))
    assert "BroadcastHashJoin" in plan
    assert "Window" not in plan


def test_profile_has_no_single_task_percentile(spark, sf_small):
    plan = plan_of(QUERIES["describe_profile"](spark, sf_small))
    assert "percentile" not in plan.lower()


def test_gap_window_is_partitioned_by_session_slice(spark, sf_small):
    plan = plan_of(QUERIES["ipa_gaps"](spark, sf_small))
    windows = re.findall(r"Window \[[^\n]*", plan)
    assert windows and all("_p" in w for w in windows if "lag(_t" in w)


def test_reply_parse_plan_stays_small(spark, sf_small):
    plan = plan_of(QUERIES["reply_parse"](spark, sf_small))
    assert "Python" not in plan and "InArrow" not in plan
    assert len(plan) < 100_000


def test_session_features_scan_the_packets_once_more_for_their_number(spark, sf_small):
    """One pass writes the sliced packets; the final plan reads that table
    for the lags and the links only."""
    plan = plan_of(QUERIES["session_time"](spark, sf_small))
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    assert len(scans) <= 2 and not any("testdata" in sc for sc in scans)


def test_quantile_passes_do_not_shuffle_the_table_by_its_keys(spark):
    """Brackets and quartiles meet the rows where they lie, also without automatic broadcasts."""
    from synthlens.operators import profile

    df = spark.range(4000).selectExpr("CAST(id % 3 AS STRING) AS g", "CAST(id * 7 % 1013 AS DOUBLE) AS a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long_df = profile.unpivot_long(df, ["a"], ["g"])
        plan = plan_of(profile.join_keys(long_df, long_df.groupBy("g", "feature").count(), ["g", "feature"]))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert "Exchange hashpartitioning" not in plan
        got = profile.exact_quantiles(long_df, ["g", "feature"], [0.5], max_rows=100, buckets=16).collect()
        assert len(got) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
