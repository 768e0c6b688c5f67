"""Runs of equal values over rows, against itertools, with buckets that nearly every run crosses."""

import datetime as dt
import itertools
import random

import pytest

from lapspark.functions.scalar import sequence_bucket
from lapspark.operators.laps import leader_runs
from lapspark.operators.ordered import with_runs_merged
from lapspark.operators.positions import position_runs
from lapspark.operators.stints import compound_runs
from tests.conftest import LAPS, POSITION, SESSION, STINTS

pytestmark = pytest.mark.usefixtures("tiny_buckets")


def expected(rows):
    out = []
    for key, part in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        for number, (value, run) in enumerate(itertools.groupby(part, key=lambda r: r[2])):
            run = list(run)
            out.append((key, number, value, run[0][1], run[-1][1], len(run)))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(5)
    return sorted(map(tuple, with_runs_merged(df, ["k"], ["o"], sequence_bucket("o"), "v").collect()))


def test_runs_cross_buckets_of_a_hot_key(spark):
    rnd = random.Random(2)
    rows = []
    for key, size in ((1, 500), (2, 9), (3, 1)):
        at = 0
        while size > 0:
            value = rnd.choice(["a", "b", None])
            for _ in range(min(size, rnd.choice([1, 1, 2, 30]))):
                at += rnd.choice([1, 1, 5])
                rows.append((key, at, value))
                size -= 1
    assert found(spark, rows) == expected(rows)


def test_one_value_alternating_values_and_no_rows(spark):
    same = [(1, i, "a") for i in range(40)]
    turns = [(2, i, "ab"[i % 2]) for i in range(40)]
    assert found(spark, same + turns) == expected(same + turns)
    assert found(spark, [(3, 1, None), (3, 2, None)]) == [(3, 0, None, 1, 2, 2)]
    assert found(spark, [(None, 1, "a")]) == [] and found(spark, []) == []


def test_no_window_over_rows_of_a_whole_key(spark):
    df = spark.createDataFrame([(1, i, "a") for i in range(10)], "k int, o int, v string")
    plan = with_runs_merged(df, ["k"], ["o"], sequence_bucket("o"), "v")._jdf.queryExecution().executedPlan().toString()
    # What is windowed over the key alone is the summary of its buckets, read back from the table of parts.
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan and "_part" in plan


def test_leader_compounds_and_positions(spark, mini):
    laps, stints, position = mini
    assert [tuple(r) for r in leader_runs(laps).collect()] == [(SESSION, 0, 1, 1, 5, 5)]
    got = sorted(tuple(r)[1:] for r in compound_runs(laps, stints).collect())
    assert got == [(1, 0, "SOFT", 1, 5, 5), (2, 0, "MEDIUM", 1, 3, 3), (2, 1, "HARD", 4, 5, 2), (3, 0, "HARD", 1, 5, 5)]
    again = spark.createDataFrame([(SESSION, 1, 1, "SOFT", 0, 1, 2), (SESSION, 1, 2, "SOFT", 0, 3, 5)], STINTS)
    assert [tuple(r)[1:] for r in compound_runs(laps, again).collect()] == [(1, 0, "SOFT", 1, 5, 5)]
    assert sorted(r.reports for r in position_runs(position).collect()) == [5, 5, 5]


def test_leader_changes_and_ties(spark):
    times = {1: [90.0, 95.0, 95.0], 2: [90.0, 91.0, 91.0], 3: [92.0, 80.0]}
    rows = [(1, d, i + 1, t, False, None) for d, ts in times.items() for i, t in enumerate(ts)]
    got = [tuple(r)[1:] for r in leader_runs(spark.createDataFrame(rows, LAPS)).orderBy("run").collect()]
    assert got == [(0, 1, 1, 1, 1), (1, 3, 2, 2, 1), (2, 2, 3, 3, 1)]


def test_positions_with_gaps_and_equal_instants(spark):
    at = [dt.datetime(2026, 1, 1) + dt.timedelta(minutes=4 * i) for i in range(5)]
    rows = [(1, 7, 3, at[0]), (1, 7, None, at[1]), (1, 7, 3, at[2]), (1, 7, 4, at[3]), (1, 7, 3, at[3]), (1, 7, 4, at[4]), (1, None, 4, at[4])]
    got = position_runs(spark.createDataFrame(rows, POSITION)).orderBy("run").collect()
    assert [(r.position, r.since, r.until, r.reports) for r in got] == [(3, at[0], at[3], 3), (4, at[3], at[4], 2)]


def test_empty(empty):
    laps, stints, position = empty
    assert leader_runs(laps).collect() == compound_runs(laps, stints).collect() == position_runs(position).collect() == []
