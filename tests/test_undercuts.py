"""The set-based swap detection against a brute-force reading of the rules."""

import datetime as dt
import random

import pytest

from lapspark.operators import strategy
from lapspark.operators.strategy import detect_undercuts, pit_laps, undercut_markers
from tests.conftest import LAPS, POSITION, STINTS

START = dt.datetime(2026, 1, 1)


def brute(place, stints, last_lap, lookahead):
    """place[(driver, lap)] -> position or None."""
    pits = {}
    for driver in {s[1] for s in stints}:
        mine = sorted((s for s in stints if s[1] == driver), key=lambda s: s[2])
        pits[driver] = {s[5] for s in mine[1:] if s[5] is not None}
    found = set()
    for a, laps in pits.items():
        for lap in laps:
            for b in pits:
                if b == a or lap in pits[b]:
                    continue
                a0, b0 = place.get((a, lap - 1)), place.get((b, lap - 1))
                if a0 is None or b0 is None:
                    continue
                for after in range(lap + 1, lap + lookahead + 1):
                    a1, b1 = place.get((a, after)), place.get((b, after))
                    if a1 is None or b1 is None:
                        continue
                    if a0 > b0 and a1 < b1:
                        found.add((lap, a, b, "undercut"))
                        break
                    if a0 <= b0 and a1 >= b1:
                        found.add((lap, b, a, "overcut"))
                        break
    return found


@pytest.mark.parametrize(("drivers", "top", "seed"), [(8, 20, 1), (8, 3, 2), (10, 5000, 3), (9, 70, 4)])
def test_matches_brute_force(spark, drivers, top, seed):
    rng = random.Random(seed)
    last = 12
    laps, position, place = [], [], {}
    for d in range(1, drivers + 1):
        known = None
        for lap in range(1, last + 1):
            end = START + dt.timedelta(seconds=100 * lap)
            laps.append((1, d, lap, 100.0, False, end))
            if rng.random() < 0.7:
                known = rng.randint(1, top)
                position.append((1, d, known, end + dt.timedelta(seconds=rng.randint(0, 90))))
            place[(d, lap)] = known
    stints = []
    for d in range(1, drivers + 1):
        cuts = sorted(rng.sample(range(2, last), 2))
        for i, (a, b) in enumerate(zip([1, *cuts], [*(c - 1 for c in cuts), last]), 1):
            stints.append((1, d, i, "SOFT", 0, a, b))
    stints.append((1, 1, 9, "SOFT", 0, None, None))
    frames = (spark.createDataFrame(laps, LAPS), spark.createDataFrame(stints, STINTS), spark.createDataFrame(position, POSITION))
    for lookahead in (1, 3):
        got = [(r.lap, r.attacking_driver, r.defending_driver, r.type) for r in detect_undercuts(*frames, lookahead).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(place, stints, last, lookahead)
    assert undercut_markers(detect_undercuts(*frames), frames[0]).where("gap is null").count() == 0


def test_first_stint_is_no_pit(spark):
    stints = spark.createDataFrame(
        [(1, 1, 1, "S", 0, 1, 5), (1, 1, 2, "S", 0, 6, 9), (1, 1, 3, "S", 0, 6, 9), (1, 2, 1, "S", 0, 1, 9),
         (1, 3, 2, "S", 0, 4, 9), (1, 3, 2, "S", 0, 4, 9)], STINTS
    )
    assert sorted((r.driver_number, r.pit_lap) for r in pit_laps(stints).collect()) == [(1, 6), (3, 4)]


def test_drivers_of_one_course_are_compared_once(spark, monkeypatch):
    """Many drivers with the same positions: one pair of courses is compared, all their drivers are paired by pieces."""
    monkeypatch.setattr(strategy, "PIECE", 4)
    monkeypatch.setattr(strategy, "DEAL", 8)
    seen = []
    drivers_of = strategy._drivers_of
    monkeypatch.setattr(strategy, "_drivers_of", lambda swaps, marked: seen.append(swaps.count()) or drivers_of(swaps, marked))
    stopping, staying = range(1, 31), range(101, 121)
    end = {lap: START + dt.timedelta(seconds=100 * lap) for lap in range(1, 9)}
    laps = [(1, d, lap, 100.0, False, end[lap]) for d in (*stopping, *staying) for lap in end]
    stints = [(1, d, 1, "S", 0, 1, 4) for d in stopping] + [(1, d, 2, "S", 0, 5, 8) for d in stopping] + [(1, d, 1, "S", 0, 1, 8) for d in staying]
    position = [(1, d, 9 if lap < 6 else 2, end[lap]) for d in stopping for lap in end] + [(1, d, 5, end[lap]) for d in staying for lap in end]
    frames = (spark.createDataFrame(laps, LAPS), spark.createDataFrame(stints, STINTS), spark.createDataFrame(position, POSITION))
    got = [tuple(r) for r in detect_undercuts(*frames, 3).collect()]
    assert sorted(got) == [(1, 5, a, b, "undercut") for a in stopping for b in staying]
    assert seen == [1]


def test_markers_shuffle_no_events(spark, monkeypatch):
    """The gap comes to the drivers before they are paired: no join or exchange lies above the pairs."""
    monkeypatch.setattr(strategy, "PIECE", 4)
    monkeypatch.setattr(strategy, "DEAL", 8)
    rng = random.Random(6)
    laps, position = [], []
    for d in range(1, 13):
        for lap in range(1, 10):
            end = START + dt.timedelta(seconds=100 * lap)
            laps.append((1, d, lap, 90.0 + rng.random() if rng.random() < 0.9 else None, False, end))
            position.append((1, d, rng.randint(1, 6), end))
    laps.append(laps[0])
    stints = [(1, d, i, "S", 0, a, b) for d in range(1, 13) for i, (a, b) in enumerate(((1, d % 4 + 2), (d % 4 + 3, 9)), 1)]
    frames = (spark.createDataFrame(laps, LAPS), spark.createDataFrame(stints, STINTS), spark.createDataFrame(position, POSITION))
    want = undercut_markers(detect_undercuts(*frames), frames[0])
    got = undercut_markers(detect_undercuts(*frames, gaps=strategy.gap_to_leader(frames[0])), frames[0]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("gap > 0").count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_bs" in plan and "Join" not in plan[:plan.index("explode(_bs")]


def test_query_of_markers_brings_the_gaps_along(spark, monkeypatch):
    from lapspark.plans import QUERIES, race

    asked = []
    monkeypatch.setattr(race.X, "undercut_markers", lambda events, laps: asked.append(events.columns) or undercut_markers(events, laps))
    out = QUERIES["undercut_markers"](spark, "/root/testdata/sf0.001")
    assert "gap" in asked[0] and out.columns == ["session_key", "attacking_driver", "lap", "defending_driver", "type", "gap"]
