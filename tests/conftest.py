import datetime as dt

import pytest

from lapspark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tiny_buckets(monkeypatch):
    """Cut ordering columns into very small chunks so that every carry path is used."""
    from lapspark.functions import scalar

    monkeypatch.setattr(scalar, "LAP_BUCKET_BITS", 1)
    monkeypatch.setattr(scalar, "VALUE_BUCKETS_PER_E", 4)


SESSION = 9999
LAPS = "session_key int, driver_number int, lap_number int, lap_duration double, is_pit_out_lap boolean, date timestamp"
STINTS = (
    "session_key int, driver_number int, stint_number int, compound string, tyre_age_at_start int, "
    "lap_start int, lap_end int"
)
POSITION = "session_key int, driver_number int, position int, date timestamp"


def _mini_laps():
    rows = []
    for driver, pace in ((1, 90.0), (2, 91.0), (3, 92.0)):
        at = dt.datetime(2026, 4, 6, 5, 0, 0)
        for lap in range(1, 6):
            took = pace + 0.1 * lap
            at += dt.timedelta(seconds=took)
            rows.append((SESSION, driver, lap, took, False, at))
    return rows


@pytest.fixture()
def mini(spark):
    rows = _mini_laps()
    laps = spark.createDataFrame(rows, LAPS)
    stints = spark.createDataFrame(
        [
            (SESSION, 1, 1, "SOFT", 0, 1, 5),
            (SESSION, 2, 1, "MEDIUM", 0, 1, 3),
            (SESSION, 2, 2, "HARD", 0, 4, 5),
            (SESSION, 3, 1, "HARD", 0, 1, 5),
        ],
        STINTS,
    )
    position = spark.createDataFrame([(SESSION, r[1], r[1], r[5]) for r in rows], POSITION)
    return laps, stints, position


@pytest.fixture()
def empty(spark):
    return tuple(spark.createDataFrame([], s) for s in (LAPS, STINTS, POSITION))
