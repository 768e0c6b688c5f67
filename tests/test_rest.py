import json

import pytest

from lapspark.race import RaceAnalysis
from lapspark.schemas import LAPS
from lapspark.sources.rest import parse_payload, read_rest


def test_backfill_reads_and_reports(spark, tmp_path):
    (tmp_path / "laps?session_key=1").write_text(json.dumps([{"driver_number": 4, "lap_number": 1, "date_start": "2026-01-01T00:00:00"}, {"driver_number": 5}]))
    (tmp_path / "laps?session_key=2").write_text("[]")
    options = {"base_url": f"file://{tmp_path}", "endpoints": "laps", "backoff": "0.01"}
    raw = read_rest(spark, session_keys="1,2,3", on_error="report", **options)
    laps = parse_payload(raw, "laps", LAPS).orderBy("driver_number").collect()
    assert [r.driver_number for r in laps] == [4, 5] and laps[0].date_start.year == 2026 and laps[1].date_start is None
    failed = raw.where("error is not null").collect()
    assert [r.session_key for r in failed] == ["3"]
    with pytest.raises(Exception, match="session_key=3"):
        read_rest(spark, session_keys="3", **options).collect()


def test_facade(mini):
    race = RaceAnalysis(*mini)
    assert race.project_finishing_order(5).count() == 3 and race.pace_summary().count() == 3
    assert race.tyre_degradation().count() == 3 and race.detect_undercuts().count() == 0
    assert race.latest_gaps().count() == 3 and race.lap_positions().count() == 15
