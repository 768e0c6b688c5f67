import datetime as dt

from pyspark.sql import functions as F

from lapspark.schemas import OUTLINES
from lapspark.session import shared_dir
from lapspark.sources import tables as S


def test_json_laps_with_absent_fields(spark, tmp_path):
    (tmp_path / "laps.json").write_text('{"driver_number": 1, "lap_number": 2, "lap_duration": 90.5, "date_start": "2026-01-01T00:00:00"}\n{"driver_number": 2, "date_start": "soon"}\n')
    rows = S.read_laps(spark, str(tmp_path), "json").orderBy("driver_number").collect()
    assert rows[0].date_start == dt.datetime(2026, 1, 1) and rows[0].st_speed is None
    assert rows[1].date_start is None and rows[1].lap_duration is None


def test_store_overwrites_only_its_sessions(spark):
    path = shared_dir(spark, "store")
    df = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 1, 2.0)], "session_key int, driver_number int, lap_number int, v double")
    S.write_lap_features(df, path)
    S.write_lap_features(df.where("session_key = 2").withColumn("v", F.lit(9.0)), path)
    got = {r.session_key: r.v for r in S.read_lap_features(spark, path).collect()}
    assert got == {1: 1.0, 2: 9.0}
    plan = S.read_table(spark, path, df.schema, session_key=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_key" in plan


def test_car_data_range_reaches_the_scan(spark):
    path = shared_dir(spark, "car")
    rows = [(1, d, dt.datetime(2026, 1, 1, 0, 0, s), 100.0) for d in (1, 2) for s in range(5)]
    spark.createDataFrame(rows, "session_key int, driver_number int, date timestamp, speed double").write.partitionBy("session_key").parquet(path)
    df = S.read_car_data(spark, path, session_key=1, driver_number=2, date_from="2026-01-01 00:00:01", date_to="2026-01-01 00:00:03")
    assert df.count() == 3 and "rpm" in df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(driver_number,2)" in plan


def test_meeting_to_sessions(spark):
    meetings = spark.createDataFrame([(7, "GP", 2024), (5, "GP", 2024), (1, "GP", 2023)], "meeting_key int, meeting_name string, year int")
    sessions = spark.createDataFrame([(1, 5, "Practice"), (2, 5, "Sprint Race"), (3, 5, "Race"), (4, 7, "Race"), (5, 9, "Sprint")], "session_key int, meeting_key int, session_name string")
    found = S.resolve_sessions(meetings, sessions, 2024, "GP")
    assert sorted(r.session_key for r in found.collect()) == [1, 2, 3]
    assert S.resolve_sessions(meetings, sessions, 2030, "GP").count() == 0
    chosen = {r.meeting_key: r.session_key for r in S.default_session(sessions, ["session_key"]).collect()}
    assert chosen == {5: 3, 7: 4, 9: 5}


def test_session_meta(spark):
    got = [S.session_meta(spark, 1, 2024, "GP", c).collect()[0].session_label for c in ("R", "SS", "X")]
    assert got == ["Race", "Sprint Shootout", "X"]


def test_audit_log_skips_damage(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"feature": "a", "prompt_tokens": 3}\n\n{oops\n{"feature": "b"}\n')
    assert sorted(r.feature for r in S.read_audit_log(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_outlines_resume(spark):
    path = shared_dir(spark, "outlines")
    one = spark.createDataFrame([("A", [1.0], [2.0])], OUTLINES)
    two = spark.createDataFrame([("A", [9.0], [9.0]), ("B", [3.0], [4.0])], OUTLINES)
    for batch in (one, two, two):
        S.refresh_outlines(spark, batch, path)
    assert sorted((r.gp_name, r.x) for r in spark.read.parquet(path).collect()) == [("A", [1.0]), ("B", [3.0])]


def test_metrics_absent_then_written(spark):
    path = shared_dir(spark, "metrics")
    scores = spark.createDataFrame([(0.5,)], "accuracy double")
    assert S.read_metrics(spark, path, scores.schema).count() == 0
    S.write_metrics(scores, path)
    assert S.read_metrics(spark, path, scores.schema).collect()[0].accuracy == 0.5
