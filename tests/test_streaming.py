import datetime as dt
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lapspark import schemas
from lapspark.operators.laps import normalise_laps
from lapspark.operators.positions import latest_position
from lapspark.operators.telemetry import fastest_lap_samples
from lapspark.session import _run_dir, materialize, scratch_tables, shared_dir
from lapspark.streaming import live
from tests.conftest import POSITION

START = dt.datetime(2026, 1, 1)


def rows_of(df):
    """Rows in order; doubles to twelve significant digits, as partial sums are merged in any order."""
    return sorted(tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r) for r in df.collect())


def land(spark, kind, rows, schema, folder, apply, state):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = {"laps": live.stream_laps, "stints": live.stream_stints, "position": live.stream_position}[kind]
    live.run_available(stream(spark, folder), apply, state)


def folders(spark):
    folder = iter(shared_dir(spark, f"live{k}") for k in range(99))
    store, results = next(folder), next(folder)
    kinds = {k: (next(folder), next(folder), live.live_analytics(store, results, k)) for k in live.KINDS}

    def arrive(kind, rows):
        landing, state, apply = kinds[kind]
        land(spark, kind, rows, live.KINDS[kind][0], landing, apply, state)

    return results, arrive, kinds


def race(sessions=(1, 2)):
    laps = [(s, d, i, 90.0 + d + i / 10, False, None, START + dt.timedelta(seconds=90 * i)) for s in sessions for d in (1, 2, 3) for i in range(1, 7)]
    pit = {1: 4, 2: 4, 3: 3}  # the last driver stops a lap before the others and comes out ahead
    stints = [(s, d, 1, "SOFT", 0, 1, pit[d] - 1) for s in sessions for d in pit]
    stints += [(s, d, 2, "SOFT", 0, pit[d], 6) for s in sessions for d in pit]
    position = [(s, d, d if i < 4 else 4 - d, START + dt.timedelta(seconds=90 * i + 200)) for s in sessions for d in (1, 2, 3) for i in range(1, 7)]
    return laps, stints, position


def test_live_analytics_equal_batch_and_replays(spark):
    laps, stints, position = race()
    results, arrive, kinds = folders(spark)
    os.makedirs(_run_dir(spark), exist_ok=True)
    before = set(os.listdir(_run_dir(spark)))
    for part in (laps[:20], laps[20:]):
        arrive("laps", part)
    arrive("position", position)
    arrive("stints", stints)
    frames = [
        normalise_laps(spark.createDataFrame(laps, schemas.LAPS)), spark.createDataFrame(stints, schemas.STINTS),
        spark.createDataFrame(position, schemas.POSITION),
    ]
    with scratch_tables(spark):
        for name, fn in live.ANALYTICS.items():
            want = fn(*frames)
            got = spark.read.parquet(f"{results}/{name}").select(*want.columns)
            assert rows_of(got) == rows_of(want), name
    assert spark.read.parquet(f"{results}/undercuts").count() > 0
    known = rows_of(spark.read.parquet(f"{results}/gap_to_leader"))
    kinds["laps"][2](spark.createDataFrame(laps[20:], schemas.LAPS), 1)  # a replayed batch changes nothing
    assert rows_of(spark.read.parquet(f"{results}/gap_to_leader")) == known
    left = set(os.listdir(_run_dir(spark))) - before
    assert all(x.startswith("live") for x in left)


def test_analytics_run_for_the_rows_they_read(spark, monkeypatch):
    """Stints change no gap to the leader; a session that a correction leaves empty goes from the results."""
    laps, stints, _ = race()
    calls = []
    gaps = live.ANALYTICS["gap_to_leader"]
    monkeypatch.setitem(live.ANALYTICS, "gap_to_leader", lambda *frames: calls.append(1) or gaps(*frames))
    store, results = shared_dir(spark, "reads-store"), shared_dir(spark, "reads-results")
    apply = {k: live.live_analytics(store, results, k, {"gap_to_leader": live.ANALYTICS["gap_to_leader"]}) for k in live.KINDS}
    apply["laps"](spark.createDataFrame(laps, schemas.LAPS), 0)
    known = rows_of(spark.read.parquet(f"{results}/gap_to_leader"))
    apply["stints"](spark.createDataFrame(stints, schemas.STINTS), 0)
    assert len(calls) == 1 and spark.read.parquet(f"{store}/stints").count() == len(stints)
    assert rows_of(spark.read.parquet(f"{results}/gap_to_leader")) == known and len(known) == len(laps)
    apply["laps"](spark.createDataFrame([(*r[:3], None, *r[4:]) for r in laps if r[0] == 2], schemas.LAPS), 1)
    left = spark.read.parquet(f"{results}/gap_to_leader")
    assert len(calls) == 2 and {r.session_key for r in left.collect()} == {1} and left.count() == len(laps) // 2


def test_samples_meet_laps_in_cells_of_time(spark):
    """Laps over several cells find all their samples, each once; one with an impossible time none."""
    at = lambda s: START + dt.timedelta(seconds=s)
    laps = [(1, 1, 1, 5000.0, False, None, at(100)), (1, 1, 2, 60.0, False, None, at(5100)), (1, 1, 3, -50.0, False, None, at(9000)),
            (1, 2, 1, 1e9, False, None, at(0))]
    car = [(1, d, at(s), 1.0, 1.0, 0.0, 1, 1) for d in (1, 2) for s in range(0, 9000, 100)]
    folders, out = {k: shared_dir(spark, k) for k in ("laps", "car")}, shared_dir(spark, "cell-samples")
    spark.createDataFrame(laps, schemas.LAPS).write.parquet(folders["laps"])
    spark.createDataFrame(car, schemas.CAR_DATA).write.parquet(folders["car"])
    stream = live.lap_samples(live.stream_laps(spark, folders["laps"]), live.stream_car_data(spark, folders["car"]), longest="2 hours", delay="1 day")
    assert "_cell" in stream._jdf.queryExecution().logical().toString()
    live.append_available(stream, out, shared_dir(spark, "cell-state"))
    got = {(r.driver_number, r.lap_number, r.date) for r in spark.read.parquet(out).collect()}
    want = {(1, 1, at(s)) for s in range(100, 5101, 100)} | {(1, 2, at(5100))} | {(2, 1, at(s)) for s in range(0, 7201, 100)}
    assert got == want and spark.read.parquet(out).count() == len(want)


def test_a_slow_batch_publishes_no_older_state(spark):
    """Positions come while a slow batch of laps is analysed: what is published last has both."""
    laps, stints, position = race()
    started, calls = threading.Event(), []

    def slow(laps, stints, position):
        calls.append(1)
        if len(calls) == 1:
            started.set()
            time.sleep(4)
        count = lambda df, name: df.groupBy("session_key").agg(F.count("*").alias(name))
        return count(laps, "n_laps").join(count(position, "n_position"), "session_key", "left")

    store, results = shared_dir(spark, "slow-store"), shared_dir(spark, "slow-results")
    apply = {k: live.live_analytics(store, results, k, {"seen": slow}) for k in ("laps", "position")}

    def late_position():
        started.wait(60)
        apply["position"](spark.createDataFrame(position, schemas.POSITION), 0)

    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(late_position), pool.submit(apply["laps"], spark.createDataFrame(laps, schemas.LAPS), 0)]
        assert [f.result() for f in both] == [None, None]
    got = {r.session_key: (r.n_laps, r.n_position) for r in spark.read.parquet(f"{results}/seen").collect()}
    assert got == {1: (18, 18), 2: (18, 18)}


def test_scopes_of_threads_do_not_meet(spark):
    """One scope ends while another is open: each removes its own tables only."""
    both_open, one_done = threading.Barrier(2), threading.Event()

    def work(first):
        with scratch_tables(spark):
            table = materialize(spark.range(10))
            both_open.wait(60)
            if not first:
                one_done.wait(60)
                return table.count()
        one_done.set()

    with ThreadPoolExecutor(2) as pool:
        assert [f.result() for f in (pool.submit(work, True), pool.submit(work, False))] == [None, 10]


def test_corrections_replace_old_results(spark):
    laps, stints, position = race()
    results, arrive, _ = folders(spark)
    arrive("laps", laps)
    # A correction leaves session 2 without any valid lap: its rows go, those of session 1 stay.
    arrive("laps", [(*r[:3], float("nan"), *r[4:]) for r in laps if r[0] == 2])
    assert {r.session_key for r in spark.read.parquet(f"{results}/gap_to_leader").collect()} == {1}
    # Positions that come later change the projection of their own session.
    arrive("position", [r for r in position if r[0] == 1])
    told = spark.read.parquet(f"{results}/projection").where("session_key = 1").collect()
    assert sorted(r.current_position for r in told) == [1, 2, 3]


def test_lap_samples_join_two_streams(spark):
    """Laps come before, after and between their samples; state covers what may still match and no more."""
    at = lambda seconds: START + dt.timedelta(seconds=seconds)
    laps = [(1, d, n, 90.0 - n % 5, n == 3, None, at(90 * n)) for d in (1, 2) for n in range(20)]
    laps += [(1, 1, 90, None, False, None, at(1800)), (1, 1, 91, 60.0, False, None, None)]
    car = [(1, d, at(5 * k), 200.0 + k % 7, 50.0, 0.0, 4, 9000) for d in (1, 2, 3) for k in range(360)]
    folders, out, state = {k: shared_dir(spark, k) for k in ("laps", "car")}, shared_dir(spark, "samples"), shared_dir(spark, "state")
    kept = []
    for part in range(10):
        for kind, rows, schema, time in (("laps", laps, schemas.LAPS, 6), ("car", car, schemas.CAR_DATA, 2)):
            ahead = 60 * (part % 3 - 1) if kind == "car" else 0
            chosen = [r for r in rows if (r[time] or START) >= at(180 * part + (ahead if part else -1))
                      and (r[time] or START) < at(180 * part + 180 + 60 * ((part + 1) % 3 - 1) * (kind == "car"))]
            if part == 9:
                chosen += [r for r in rows if (r[time] or START) >= at(1800)]
            spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(folders[kind])
        stream = live.lap_samples(live.stream_laps(spark, folders["laps"]), live.stream_car_data(spark, folders["car"]),
                                  longest="2 minutes", delay="3 minutes")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators))
    everything = [spark.read.schema(s).parquet(folders[k]).distinct() for k, s in (("laps", schemas.LAPS), ("car", schemas.CAR_DATA))]
    columns = ["session_key", "driver_number", "lap_number", "lap_time", "date", "speed"]
    got = live.fastest_lap_samples(spark.read.parquet(out).distinct(), everything[0]).select(*columns)
    want = fastest_lap_samples(*everything).select(*columns)
    assert rows_of(got) == rows_of(want) and got.count() > 10
    assert max(kept[4:]) <= 1.5 * max(kept[:4]) and max(kept) < len(car) / 2


def test_late_rows_are_added_from_the_source(spark):
    out = shared_dir(spark, "unique")
    source = spark.createDataFrame([(1, 1, 4, START), (1, 1, 4, START), (1, 2, 4, START)], POSITION)
    source.limit(1).write.parquet(out)
    for _ in range(2):
        live.add_late_rows(source, out, ["session_key", "driver_number", "date"])
    assert spark.read.parquet(out).count() == 2


def test_latest_position_upsert(spark):
    out, landing, state = (shared_dir(spark, n) for n in ("out", "in", "state"))
    batches = [
        [(1, 1, 4, START), (1, 2, 5, START), (2, 1, 9, START)],
        [(1, 1, 3, START + dt.timedelta(seconds=9)), (1, 2, None, START + dt.timedelta(seconds=9))],
        [(1, 1, 8, START + dt.timedelta(seconds=1))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, POSITION).coalesce(1).write.mode("append").parquet(landing)
        live.run_available(live.stream_position(spark, landing), live.upsert_latest_position(out), state)
    got = spark.read.parquet(out).select("session_key", "driver_number", "position", "date")
    assert rows_of(got) == rows_of(latest_position(spark.read.parquet(landing)))


def test_duplicates_are_dropped_across_batches(spark):
    landing, out, state = (shared_dir(spark, n) for n in ("dup", "unique", "state"))
    one = [(1, 1, 4, START), (1, 1, 4, START), (1, 2, 4, START)]
    for batch in (one, one):
        spark.createDataFrame(batch, POSITION).coalesce(1).write.mode("append").parquet(landing)
        stream = live.deduplicate(live.stream_position(spark, landing), ["session_key", "driver_number", "date"])
        live.append_available(stream, out, state)
    assert spark.read.parquet(out).count() == 2


def test_latest_session(spark):
    df = spark.createDataFrame([(1, 1), (7, 2), (7, 3)], "session_key int, driver_number int")
    assert sorted(r.driver_number for r in live.latest_session(df).collect()) == [2, 3]


def test_position_updates_after_replays_and_late_rows(spark):
    landing, out = shared_dir(spark, "position"), shared_dir(spark, "updates")
    at = [START + dt.timedelta(seconds=10 * i) for i in range(6)]
    parts = [
        [(1, 1, 4, at[2]), (1, 2, 5, at[2])], [(1, 1, 9, at[0]), (1, 2, None, at[5])],
        [(1, 1, 3, at[4]), (1, 1, 2, at[4]), (2, 1, 1, at[1])],
    ]
    state = shared_dir(spark, "updates-state")
    assert live.current_positions(spark, out).collect() == []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, POSITION).coalesce(1).write.mode("append").parquet(landing)
        updates = live.latest_position_updates(live.stream_position(spark, landing))
        live.start_updates(updates, out, state).awaitTermination()
        want = latest_position(spark.createDataFrame(sum(parts[: n + 1], []), POSITION))
        got = live.current_positions(spark, out).select(*want.columns)
        assert rows_of(got) == rows_of(want)
    # A batch stores the drivers it touches and nothing else; one written again changes nothing.
    last = spark.read.parquet(f"{out}/batch_id=2")
    assert sorted((r.session_key, r.driver_number) for r in last.collect()) == [(1, 1), (2, 1)]
    again = spark.createDataFrame(last.collect(), last.schema)
    again.write.mode("overwrite").parquet(f"{out}/batch_id=2")
    assert rows_of(live.current_positions(spark, out).select(*want.columns)) == rows_of(want)


def test_position_updates_on_a_timer(spark):
    landing, out = shared_dir(spark, "position"), shared_dir(spark, "updates")
    os.makedirs(landing)
    updates = live.latest_position_updates(live.stream_position(spark, landing))
    query = live.start_updates(updates, out, shared_dir(spark, "updates-state"), "1 second")
    try:
        for i in range(3):
            row = (1, 1, i + 1, START + dt.timedelta(seconds=i))
            spark.createDataFrame([row], POSITION).coalesce(1).write.mode("append").parquet(landing)
            query.processAllAvailable()
            assert [r.position for r in live.current_positions(spark, out).collect()] == [i + 1]
        assert query.lastProgress["batchId"] >= 2 and query.isActive
    finally:
        query.stop()


def test_stream_join_keeps_no_copies(spark, tmp_path):
    """Samples lie on the disk as landed, in the state and as joined; when the stream is over only the joined ones stay."""
    import glob
    import os

    from lapspark import session
    from lapspark.plans import QUERIES

    rows = [
        (order, line, (order * 7 + line) % 40, float(order % 50 + 1), 900.0 + order % 97, 0.05, 0.02, order % 3 + 1)
        for order in range(0, 12_000, 60) for line in (1, 2)
    ]
    spark.createDataFrame(
        rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    base = session._run_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/*"))
    got = QUERIES["live_fastest_lap_samples"](spark, str(tmp_path))
    want = QUERIES["fastest_lap_samples"](spark, str(tmp_path)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    fresh = [os.path.basename(x).rsplit("-", 1)[0] for x in set(glob.glob(f"{base}/*")) - before]
    assert "landing-car" not in fresh and "lap-samples-state" not in fresh
    joined = next(x for x in glob.glob(f"{base}/lap-samples-*") if x not in before)
    assert set(spark.read.parquet(joined).columns) == {"session_key", "driver_number", "lap_number", "date", "speed", "lap_time"}


def test_materialized_tables_leave_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from lapspark.session import materialize

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.name() for b in (disk.getAllBlocks().apply(i) for i in range(disk.getAllBlocks().size())) if b.name().startswith("shuffle")}
    before = files()
    rows = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")))
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before and rows.count() == 7
