"""Plan checks with broadcasting off, as for tables far beyond any broadcast threshold."""

import re

import pytest

from lapspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "gap_to_leader", "clean_laps", "rolling_pace", "rolling_pace_median", "pace_summary", "asof_positions",
    "lap_positions", "laps_with_stints", "stint_degradation", "detect_undercuts", "undercut_windows",
    "project_finish", "resample", "lap_features", "mean_trace", "percentile_rank", "cosine_topk", "cap_history",
    "normalised_profile", "fastest_lap_samples", "check_membership", "validate_report", "sanitize_text",
]


@pytest.fixture()
def big_tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", CHECKED)
def test_no_single_task_and_no_cross_join(big_tables, name):
    plan = QUERIES[name](big_tables, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "PythonUDF", "InPandas", "BatchEvalPython"):
        assert bad not in plan, bad


def test_limits_are_applied_before_the_shuffle(big_tables):
    plan = QUERIES["cap_history"](big_tables, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_projection_reaches_the_scan(spark):
    plan = QUERIES["fastest_lap_samples"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "throttle" not in plan.split("Relation")[0]


def test_every_sql_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 90


@pytest.mark.parametrize("name", ["percentile_rank", "undercut_markers", "time_delta", "gap_to_leader"])
def test_statistics_are_not_copied(big_tables, name):
    old = big_tables.conf.get("spark.sql.shuffle.partitions")
    big_tables.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        plan = QUERIES[name](big_tables, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        big_tables.conf.set("spark.sql.shuffle.partitions", old)
    assert "_salt" not in plan


@pytest.mark.parametrize("name", ["position_at", "detect_undercuts"])
def test_lookups_build_no_grid(big_tables, name):
    plan = QUERIES[name](big_tables, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_own" not in plan and "_count" not in plan
