import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapspark.operators import laps as L
from lapspark.operators import positions as P
from lapspark.operators import stints as S
from lapspark.operators import strategy as X
from tests.conftest import LAPS, POSITION, SESSION, STINTS


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def at(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def test_clean_laps_keeps_everything(mini):
    assert L.clean_laps(mini[0]).count() == 15


def test_clean_laps_limit_is_inclusive_and_null_flag_is_kept(spark):
    rows = [(1, 1, i, d, p, None) for i, (d, p) in enumerate(
        [(100.0, None), (100.0, False), (100.0, None), (110.00000000000001, None), (110.1, None), (90.0, True),
         (0.0, None), (-5.0, None), (None, None), (float("nan"), None)], 1)]
    laps = L.normalise_laps(spark.createDataFrame(rows, LAPS))
    assert sorted(r.lap_number for r in L.clean_laps(laps).collect()) == [1, 2, 3, 4]


def test_sessions_do_not_mix(spark):
    rows = [(s, 1, i, base + i, False, None) for s, base in ((1, 60.0), (2, 600.0)) for i in range(1, 6)]
    laps = spark.createDataFrame(rows, LAPS)
    assert L.clean_laps(laps).count() == 10
    assert by(L.gap_to_leader(laps), "session_key", "lap_number")[(2, 5)].gap == 0


def test_rolling_pace(mini):
    got = by(L.rolling_pace(mini[0], 5), "driver_number", "lap_number")
    assert [round(got[(d, 5)].rolling_pace, 6) for d in (1, 2, 3)] == [90.3, 91.3, 92.3]
    assert got[(1, 1)].rolling_pace == pytest.approx(90.1)


def test_rolling_pace_full_window(spark):
    laps = spark.createDataFrame([(1, 1, i, d, None, None) for i, d in enumerate((90.0, 92.0, 94.0), 1)], LAPS)
    got = by(L.rolling_pace(laps, 2, clean=False), "lap_number")
    assert [got[(i,)].rolling_pace for i in (1, 2, 3)] == [None, 91.0, 93.0]


def test_gap_to_leader(mini):
    got = by(L.gap_to_leader(mini[0]), "driver_number", "lap_number")
    assert [round(got[(d, 1)].gap, 6) for d in (1, 2, 3)] == [0, 1, 2]
    assert [round(got[(d, 5)].gap, 6) for d in (1, 2, 3)] == [0, 5, 10]
    wide = L.pivot_by_driver(L.gap_to_leader(mini[0]), "gap", [1, 2, 3]).collect()
    assert len(wide) == 5 and all(r["1"] == 0 for r in wide)


def test_gap_counts_repeated_laps(spark):
    laps = spark.createDataFrame([(1, 1, 1, 10.0, None, None), (1, 1, 1, 5.0, None, None), (1, 2, 1, 12.0, None, None)], LAPS)
    got = by(L.gap_to_leader(laps), "driver_number")
    assert got[(1,)].gap == 3.0 and got[(2,)].gap == 0.0


def test_pace_summary(mini, spark):
    row = by(L.pace_summary(mini[0]), "driver_number")[(1,)]
    assert row.mean_pace == pytest.approx(90.3) and row.median_pace == pytest.approx(90.3)
    assert row.std_pace == pytest.approx(0.158114, abs=1e-6)
    assert (round(row.fastest_lap, 6), row.lap_count) == (90.1, 5)
    laps = spark.createDataFrame([(1, 1, 1, 90.0, False, None), (1, 1, 2, 91.0, None, None), (1, 1, 3, 130.0, True, None)], LAPS)
    row = L.pace_summary(laps).collect()[0]
    assert (row.fastest_lap, row.lap_count) == (90.0, 2)
    single = spark.createDataFrame([(1, 1, 1, 90.0, False, None)], LAPS)
    assert L.pace_summary(single).collect()[0].std_pace is None


def test_pace_ranking(mini):
    got = by(L.pace_ranking(mini[0]), "driver_number")
    assert [got[(d,)]["rank"] for d in (1, 2, 3)] == [1, 2, 3]
    down = by(L.pace_ranking(mini[0], "median_pace", ascending=False), "driver_number")
    assert [down[(d,)]["rank"] for d in (1, 2, 3)] == [3, 2, 1]


def test_latest(mini):
    pace = L.latest_pace(mini[0], 5, 2).orderBy("rank").collect()
    assert [(r.driver_number, r.lap_number) for r in pace] == [(1, 5), (2, 5)]
    gaps = L.latest_gaps(mini[0]).orderBy("rank").collect()
    assert [round(r.gap, 6) for r in gaps] == [0, 5, 10]


def test_lap_end_is_derived(spark):
    laps = spark.createDataFrame([(1, 1, 1, 1.5, at(0))], "session_key int, driver_number int, lap_number int, lap_duration double, date_start timestamp")
    assert L.normalise_laps(laps).collect()[0].date == at(1.5)


def test_lap_positions(mini):
    rows = P.lap_positions(mini[2], mini[0]).collect()
    assert len(rows) == 15 and all(r.position == r.driver_number for r in rows)


def test_lap_positions_gaps(spark):
    laps = spark.createDataFrame([(1, d, i, 10.0, None, at(10 * i)) for d in (1, 2, 3) for i in (1, 2, 3, 5)], LAPS)
    position = spark.createDataFrame(
        [(1, 1, 4, at(21)), (1, 1, 3, at(22)), (1, 1, None, at(31)), (1, 2, 9, at(5)), (1, 3, None, at(15))], POSITION
    )
    got = by(P.lap_positions(position, laps), "driver_number", "lap_number")
    assert [got[(1, i)].position for i in (1, 2, 3, 5)] == [None, 3, 3, 3]
    assert (2, 1) not in got  # reported before any lap was completed
    assert [got[(3, i)].position for i in (1, 2, 3, 5)] == [None] * 4


def test_stints(mini):
    got = by(S.stint_degradation(mini[0], mini[1]), "driver_number", "stint_number")
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert [round(got[k].deg_per_lap, 4) for k in sorted(got)] == [0.1, 0.1, 0.1]
    assert [round(got[k].mean_pace, 3) for k in sorted(got)] == [90.3, 91.2, 92.3]
    assert [got[k].laps_in_stint for k in sorted(got)] == [5, 3, 5]


def test_overlapping_and_open_stints(spark, mini):
    stints = spark.createDataFrame(
        [(SESSION, 1, 1, "SOFT", None, 1, 3), (SESSION, 1, 2, "HARD", 4, 3, 100000), (SESSION, 1, 3, "HARD", 0, None, 5)], STINTS
    )
    joined = S.laps_with_stints(mini[0], stints).collect()
    assert sorted((r.lap_number, r.stint_number) for r in joined) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (5, 2)]
    age = by(S.tyre_age(mini[0], stints), "lap_number")
    assert (age[(3,)].stint_number, age[(3,)].tyre_age, age[(2,)].tyre_age) == (2, 4, 1)


def test_undercuts_none(mini):
    assert X.detect_undercuts(*mini).count() == 0


def test_projection(mini):
    got = by(X.project_finish(*mini, laps_remaining=5, with_gap=True), "driver_number")
    assert [got[(d,)].projected_total_time for d in (1, 2, 3)] == [903.0, 913.0, 923.0]
    assert [got[(d,)].projected_position for d in (1, 2, 3)] == [1, 2, 3]
    assert all(r.position_change == 0 and r.status == "running" for r in got.values())
    assert got[(2,)].change_label == "P2 → P2" and got[(3,)].gap_to_winner == 20.0
    none_left = by(X.project_finish(*mini, laps_remaining=0), "driver_number")
    assert [none_left[(d,)].projected_total_time for d in (1, 2, 3)] == [451.5, 456.5, 461.5]
    simple = by(X.project_finish_simple(mini[0], 10), "driver_number")
    assert [simple[(d,)].projected_total for d in (1, 2, 3)] == [903.0, 913.0, 923.0]


def test_projection_wear_and_retirement(spark):
    rows = [(1, d, i, 100.0, False, at(100 * i)) for d, last in ((1, 10), (2, 10), (3, 4), (4, 10)) for i in range(1, last + 1)]
    rows = [r if r[1] != 4 else (*r[:4], True, r[5]) for r in rows]  # driver 4 has no clean laps
    stints = spark.createDataFrame([(1, 1, 1, "S", 9, 1, 10), (1, 2, 1, "S", 0, 1, 10)], STINTS)
    empty_position = spark.createDataFrame([], POSITION)
    got = by(X.project_finish(spark.createDataFrame(rows, LAPS), stints, empty_position, 5), "driver_number")
    wear = sum(0.07 * max(0, 18 + i - 20) for i in range(1, 6))
    assert got[(1,)].projected_total_time == pytest.approx(1500 + wear)
    assert got[(2,)].projected_total_time == 1500.0
    assert [got[(d,)].projected_position for d in (2, 1, 4, 3)] == [1, 2, 3, 4]
    assert got[(4,)].projected_total_time == float("inf") and got[(4,)].status == "running"
    assert got[(3,)].status == "DNF" and got[(3,)].position_change is None


def test_empty_inputs_are_typed(empty):
    laps, stints, position = empty
    for df in (
        L.clean_laps(laps), L.rolling_pace(laps), L.gap_to_leader(laps), L.pace_summary(laps),
        P.lap_positions(position, laps), S.stint_degradation(laps, stints), X.undercut_windows(laps, stints),
        X.detect_undercuts(laps, stints, position), X.project_finish(laps, stints, position),
        X.project_finish_simple(laps, 10),
    ):
        assert df.count() == 0 and len(df.columns) > 1


def test_null_driver_is_dropped(spark):
    laps = spark.createDataFrame([(1, None, 1, 90.0, False, None), (1, 2, 1, 91.0, False, None)], LAPS)
    assert [r.driver_number for r in L.gap_to_leader(laps).collect()] == [2]


def test_undercut_window(spark):
    laps = spark.createDataFrame([(1, 1, 5, 90.0, None, None), (1, 2, 5, 91.0, None, None), (1, 3, 5, 95.0, None, None)], LAPS)
    stints = spark.createDataFrame([(1, 1, 1, "S", 10, 1, 9), (1, 2, 1, "S", 0, 1, 9), (1, 3, 1, "S", 0, 1, 9)], STINTS)
    row = X.undercut_windows(laps, stints).collect()
    assert [(r.driver_number, r.target_driver, r.pace_delta, r.tyre_age_delta) for r in row] == [(2, 1, 1.0, 10)]


def rows_of(df):
    """Rows in order; doubles to twelve significant digits, as partial sums are merged in any order."""
    return sorted(str([float(f"{v:.12g}") if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_nan_counts_as_missing_everywhere(mini):
    laps, stints, position = mini
    gone = (F.col("lap_number") % 4 == 2) & (F.col("driver_number") % 2 == 0)
    null = laps.withColumn("lap_duration", F.when(~gone, F.col("lap_duration")))
    nan = laps.withColumn("lap_duration", F.when(gone, F.lit(float("nan"))).otherwise(F.col("lap_duration")))
    operators = {
        "valid": lambda d: L.valid_laps(d).drop("date"), "clean": lambda d: L.clean_laps(d),
        "quick": lambda d: L.quick_laps(d, 1.2, "lap_duration"), "rolling": L.rolling_pace,
        "rolling_full": lambda d: L.rolling_pace(d, 3, clean=False).select(*L.LAP, "rolling_pace"),
        "summary": L.pace_summary, "gap": L.gap_to_leader, "fastest": L.fastest_laps,
        "degradation": lambda d: S.stint_degradation(d, stints, clean=False),
        "windows": lambda d: X.undercut_windows(d, stints), "projection": lambda d: X.project_finish(d, stints, position),
        "simple": lambda d: X.project_finish_simple(d, 20),
    }
    for name, fn in operators.items():
        assert rows_of(fn(nan)) == rows_of(fn(null)), name


def test_arguments_are_checked_not_changed(mini):
    laps, stints, position = mini
    for call in (lambda: L.latest_pace(laps, window=0), lambda: L.latest_pace(laps, top_n=0),
                 lambda: X.detect_undercuts(laps, stints, position, lookahead=0),
                 lambda: X.project_finish(laps, stints, position, laps_remaining=-1)):
        with pytest.raises(ValueError):
            call()


def test_many_rows_when_asked(spark):
    laps = spark.createDataFrame([(1, d, 1, 90.0 + d / 10, False, None) for d in range(60)], LAPS)
    assert L.latest_pace(laps, top_n=50).count() == 50
