import datetime as dt

import pytest

from lapspark import schemas
from lapspark.session import shared_dir
from lapspark.sources import quarantine as Z

NEEDED = ["session_key", "driver_number"]
LINES = [
    '{"session_key": 1, "driver_number": 2, "lap_number": 3, "lap_duration": 90.5, "date_start": "2026-01-01T00:00:00"}',
    '{"session_key": 1, "driver_number": 2, "lap_number": 4, "unknown": [1]}',
    "{oops", "[3]", "7", "   ", "",
    '{"session_key": 1, "driver_number": "two"}',
    '{"session_key": 1, "lap_number": 5}',
    '{"driver_number": 1, "session_key": null, "date_start": "soon"}',
    '{"session_key": 1, "driver_number": 9, "date_start": "soon"}',
]


def run(spark, tmp_path, lines):
    (tmp_path / "laps.json").write_text("\n".join(lines))
    target = shared_dir(spark, "checked")
    counts = Z.ingest_checked(spark, str(tmp_path), target, schemas.LAPS, NEEDED)
    return counts, target


def test_rejects_are_kept_and_counted(spark, tmp_path):
    counts, target = run(spark, tmp_path, LINES)
    assert counts == {
        "lines": 9, "good": 2, "bad line": 4, "missing session_key": 1, "missing driver_number": 1, "bad time date_start": 1}
    good = {r.lap_number: r for r in Z.good_rows(spark, target, schemas.LAPS).collect()}
    assert set(good) == {3, 4} and good[3].date_start == dt.datetime(2026, 1, 1) and good[4].lap_duration is None
    told = Z.rejected_lines(spark, target, schemas.LAPS)
    kept = [(r.reason, r.line) for r in told.collect()]
    assert sorted(line for _, line in kept) == sorted(x for x in LINES[2:] if x.strip())
    assert ("bad time date_start", LINES[-1]) in kept and ("missing session_key", LINES[-2]) in kept
    plan = Z.good_rows(spark, target, schemas.LAPS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "rejected" in plan


def test_the_lines_are_read_once(spark, tmp_path):
    (tmp_path / "laps.json").write_text("\n".join(LINES))
    rows = Z.checked_lines(spark.read.text(str(tmp_path)), schemas.LAPS, NEEDED)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_all_good_none_and_wrong_arguments(spark, tmp_path):
    counts, target = run(spark, tmp_path, LINES[:2])
    assert counts["good"] == counts["lines"] == 2 and Z.rejected_lines(spark, target, schemas.LAPS).count() == 0
    counts, target = run(spark, tmp_path, [""])
    assert counts["lines"] == 0
    with pytest.raises(ValueError):
        Z.checked_lines(spark.range(1).selectExpr("'' AS value"), schemas.LAPS, ["speed"])
