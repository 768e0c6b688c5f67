import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapspark.functions.scalar import upsample
from lapspark.operators import compare as C
from lapspark.operators import telemetry as T
from lapspark.operators.laps import LAP
from lapspark.operators.ordered import BUCKET
from lapspark.sources import adapters

KEYS = ["session_key", "driver_number", "lap_number"]


def lap(driver, number, distance, **channels):
    n = len(distance)
    data = {"session_key": 1, "driver_number": driver, "lap_number": number, "sample_no": range(1, n + 1), "distance": distance}
    return pd.DataFrame({**data, **channels})


@pytest.fixture()
def random_laps():
    rng = np.random.default_rng(13)
    out = []
    for i in range(12):
        n = int(rng.integers(10, 60))
        d = np.cumsum(rng.choice([0.0, 0.0, 1.0, 3.7, 50.0], n))
        if i == 0:
            d = np.zeros(n)
        out.append(lap(i % 4, i // 4 + 1, d, speed=rng.normal(200, 40, n), throttle=rng.choice([0.0, 1.0, 50.0, 100.0], n),
                       brake=rng.choice([0.0, 0.0, 0.5, 100.0], n), n_gear=rng.integers(1, 8, n).astype(float),
                       x=rng.normal(0, 9, n), y=rng.normal(0, 9, n), steer=rng.normal(0, 1, n)))
    return out


def grid_of(pdf, channel, n=200):
    d = pdf["distance"].to_numpy(float)
    return np.interp(np.linspace(d[0], d[-1], n), d, pdf[channel].to_numpy(float))


def test_resample_equals_interp(spark, random_laps, tiny_buckets):
    sdf = spark.createDataFrame(pd.concat(random_laps))
    got = T.resample(sdf, KEYS, "sample_no", "distance", ["speed", "rpm"]).toPandas()
    assert got["rpm"].isna().all()
    for pdf in random_laps:
        mine = got[(got.driver_number == pdf.driver_number[0]) & (got.lap_number == pdf.lap_number[0])].sort_values("k")
        assert mine["k"].tolist() == list(range(200))
        np.testing.assert_array_equal(mine["speed"], grid_of(pdf, "speed"))


def test_resample_by_hand(spark):
    sdf = spark.createDataFrame(lap(1, 1, [0.0, 10.0, 20.0], speed=[0.0, 100.0, 0.0]))
    got = T.resample(sdf, KEYS, "sample_no", "distance", ["speed"], 5).orderBy("k").collect()
    assert [r.speed for r in got] == [0, 50, 100, 50, 0]


def test_lap_features(spark, random_laps):
    short = lap(9, 1, np.arange(9.0), **{c: np.ones(9) for c in ("speed", "throttle", "brake", "n_gear", "x", "y", "steer")})
    rows = T.extended_features(T.lap_features(spark.createDataFrame(pd.concat([*random_laps, short]))))
    got = rows.toPandas().set_index(["driver_number", "lap_number"])
    assert len(got) == len(random_laps)  # nine samples are too few
    for pdf in random_laps:
        row = got.loc[(pdf.driver_number[0], pdf.lap_number[0])]
        speed, thr, brk, gear = (grid_of(pdf, c) for c in ("speed", "throttle", "brake", "n_gear"))
        assert row.mean_speed == pytest.approx(speed.mean()) and row.max_speed == speed.max()
        assert row.throttle_std == pytest.approx(thr.std()) and row.steer_std == pytest.approx(grid_of(pdf, "steer").std())
        assert row.brake_events == np.diff((brk > 0).astype(int)).clip(min=0).sum()
        assert row.gear_changes == (np.diff(np.round(gear)) != 0).sum()
        assert row.coasting_pct == pytest.approx(((thr < 2) & (brk < 1)).mean())
        assert row.trail_brake_score == pytest.approx(((thr > 0) & (brk > 0)).mean())
        np.testing.assert_array_equal(row.speed_trace, speed)


def test_absent_steer_is_zero(spark):
    sdf = spark.createDataFrame(lap(1, 1, np.arange(12.0), speed=np.arange(12.0)))
    row = T.lap_features(sdf).collect()[0]
    assert row.steer_std == 0.0 and row.throttle_mean is None and row.max_speed == 11.0


def test_trace_fractions(spark):
    nan = float("nan")
    data = [(1, [0.7] * 200, [0.2] * 200), (2, [100.0] * 50 + [0.0] * 150, [0.0] * 200), (3, [nan] + [100.0] * 199, [1.0] * 200), (4, [], [])]
    df = spark.createDataFrame(data, "i int, throttle_trace array<double>, brake_trace array<double>")
    got = {r.i: (r.coasting_pct, r.throttle_pickup_pct, r.trail_brake_score) for r in T.extended_features(df).collect()}
    assert got[1] == (1.0, 0.0, 1.0) and got[2] == (0.75, 0.25, 0.0)
    assert got[3] == (0.0, 199 / 200, 199 / 200) and got[4] == (None, None, None)


def test_mean_trace_and_zones(spark):
    ramp = [float(i) for i in range(200)]
    rows = [(1, 1, ramp), (1, 1, [v + 2 for v in ramp])]
    df = spark.createDataFrame(rows, "session_key int, driver_number int, speed_trace array<double>")
    long = T.mean_trace(df, ["session_key", "driver_number"], ["speed_trace"])
    packed = T.pack_trace(long, ["session_key", "driver_number"], ["speed_trace"]).collect()[0]
    assert packed.speed_trace == [v + 1 for v in ramp]
    zones = T.zone_means(df.limit(1), ["session_key", "driver_number"], "speed_trace").orderBy("zone").collect()
    assert [z.zone_mean for z in zones] == [33.0, 100.0, 166.5]


def test_axis_violations(spark):
    good, bad = lap(1, 1, [0.0, 1.0, 1.0]), lap(1, 2, [0.0, 5.0, 4.0])
    got = T.axis_violations(spark.createDataFrame(pd.concat([good, bad])), KEYS, "sample_no", "distance").collect()
    assert [(r.lap_number, r.decreasing_steps) for r in got] == [(2, 1)]


def test_fastest_lap_traces(spark):
    rng = np.random.default_rng(17)
    start = pd.Timestamp("2026-01-01")
    laps, car, want = [], [], {}
    for d in (1, 2):
        at = start
        for number, seconds in ((1, 95.0), (2, 90.0 + d), (3, 91.5 + d)):
            laps.append((1, d, number, seconds, False, at.to_pydatetime()))
            t = np.cumsum(rng.uniform(0.1, 0.6, 400))
            t = t[t <= seconds]
            part = pd.DataFrame({"session_key": 1, "driver_number": d, "date": [at + dt.timedelta(microseconds=round(v * 1e6)) for v in t],
                                 "speed": rng.choice([0.0, 120.0, 300.0], len(t)), "throttle": rng.random(len(t)), "brake": rng.random(len(t))})
            car.append(part)
            if number == 2:
                want[d] = part
            at += dt.timedelta(seconds=seconds + 5)
    lap_df = spark.createDataFrame(laps, "session_key int, driver_number int, lap_number int, lap_duration double, is_pit_out_lap boolean, date_start timestamp")
    traces = T.fastest_lap_traces(lap_df, spark.createDataFrame(pd.concat(car))).toPandas().set_index("driver_number")
    for d, part in want.items():
        sec = (part["date"] - part["date"].iloc[0]).dt.total_seconds().to_numpy()
        dist = np.concatenate([[0.0], np.cumsum(part["speed"].to_numpy()[:-1] / 3.6 * np.diff(sec))])
        grid = np.linspace(0, dist[-1], 200)
        row = traces.loc[d]
        assert row.lap_number == 2 and row.lap_time == 90.0 + d
        np.testing.assert_allclose(row.cumtime, np.interp(np.linspace(0, 1, 200), np.linspace(0, 1, len(sec)), sec), atol=1e-9)
        inside = np.array([g not in dist for g in grid])
        np.testing.assert_allclose(np.array(row.speed_trace)[inside], np.interp(grid, dist, part["speed"])[inside], rtol=1e-6)


def pairs_of(spark, a, b, speed_a=None, speed_b=None):
    rows = [(1, 1, 2, a, b, speed_a or a, speed_b or b)]
    return spark.createDataFrame(rows, "session_key int, driver_a int, driver_b int, cumtime_a array<double>, cumtime_b array<double>, speed_trace_a array<double>, speed_trace_b array<double>")


def test_time_delta(spark):
    a, b = [0.0, 1.0, 2.0, 3.0, 4.0], [0.0, 1.5, 1.8, 3.2, 4.0]
    delta = C.time_delta(pairs_of(spark, a, b))
    rows = delta.orderBy("k").collect()
    signs = np.sign(np.round(np.array(b) - np.array(a), 9))
    assert [r.lead_change for r in rows][:-1] == (np.diff(signs) != 0).tolist() and not rows[-1].lead_change
    s = C.time_delta_summary(delta).collect()[0]
    assert (s.lead_changes, s.peak_a_k, s.peak_b_k, s.ahead_at_finish) == (4, 1, 2, "dead heat")
    assert s.peak_a == pytest.approx(0.5) and s.peak_b == pytest.approx(-0.2)
    flat = C.time_delta_summary(C.time_delta(pairs_of(spark, a, [v + 0.01 for v in a]))).collect()[0]
    assert flat.peak_a is None and flat.peak_b is None and flat.ahead_at_finish == "a"


def test_microsectors(spark):
    rng = np.random.default_rng(19)
    a, b = rng.random(200).tolist(), rng.random(150).tolist()
    sectors = C.microsectors(pairs_of(spark, a, b, a, b))
    t = np.linspace(0, 1, 1000)
    fa, fb = np.interp(t, np.linspace(0, 1, 200), a), np.interp(t, np.linspace(0, 1, 150), b)
    want = np.where(fa[:-1] >= fb[:-1], "a", "b")
    assert [r.winner for r in sectors.orderBy("k").collect()] == want.tolist()
    runs = C.microsector_runs(pairs_of(spark, a, b, a, b)).orderBy("run").collect()
    assert runs[0].first_point == 0 and runs[-1].last_point == 999
    assert all(p.last_point == q.first_point and p.winner != q.winner for p, q in zip(runs, runs[1:]))


def test_upsample_single_point(spark):
    df = spark.createDataFrame([([5.0],), ([],)], "a array<double>").select(upsample(F.col("a"), 4).alias("u"))
    assert [r.u for r in df.collect()] == [[5.0] * 4, None]


def test_representative_lap_and_outline(spark):
    laps = spark.createDataFrame([(1, 2, 1, 80.0), (1, 2, 2, 79.0), (1, 2, 3, 200.0), (1, 3, 1, 70.0)], "session_key int, driver_number int, lap_number int, lap_time_seconds double")
    assert T.representative_lap(laps, 1.07).collect()[0][1:] == (2, 2)
    sdf = spark.createDataFrame(lap(2, 2, [0.0, 100.0], x=[0.0, 1.0], y=[5.0, 7.0]))
    out = T.circuit_outline(sdf, laps, 1.07).orderBy("k").collect()
    assert len(out) == 500 and out[-1].y == 7.0


def test_quick_laps_feed_features(spark, random_laps):
    laps = spark.createDataFrame([(1, d, n, 80.0 + 10 * n) for d in range(4) for n in (1, 2, 3)], "session_key int, driver_number int, lap_number int, lap_time_seconds double")
    got = T.timed_lap_features(spark.createDataFrame(pd.concat(random_laps)), laps, 1.12)
    assert sorted({r.lap_number for r in got.select(*LAP).collect()}) == [1, 2]


def line_items(spark, path):
    """Two suppliers, orders far enough apart for several buckets."""
    rng = np.random.default_rng(5)
    n = 300
    rows = pd.DataFrame({
        "l_orderkey": rng.integers(1, 40, n) * 400_000, "l_linenumber": np.arange(n) % 7 + 1, "l_partkey": rng.integers(0, 10, n),
        "l_suppkey": rng.integers(1, 3, n), "l_quantity": rng.integers(1, 50, n).astype(float),
        "l_extendedprice": rng.uniform(900, 90_000, n), "l_discount": rng.integers(0, 10, n) / 100, "l_tax": rng.integers(0, 8, n) / 100,
        "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": dt.date(1996, 1, 1)})
    spark.createDataFrame(rows).write.parquet(f"{path}/lineitem.parquet")


def test_samples_stay_dealt(spark, tmp_path):
    """Samples are not written on the way, and features of laps in several buckets equal those of laps in one."""
    line_items(spark, tmp_path)
    samples = adapters.samples(spark, str(tmp_path))
    assert all("lineitem.parquet" in f for f in samples.inputFiles())
    assert samples.groupBy(*KEYS).agg(F.countDistinct(BUCKET).alias("n")).agg(F.max("n")).first()[0] > 2
    dealt = T.lap_features(samples).toPandas().sort_values(KEYS).reset_index(drop=True)
    whole = T.lap_features(samples.drop(BUCKET)).toPandas().sort_values(KEYS).reset_index(drop=True)
    assert len(dealt) == 10 and list(dealt.columns) == list(whole.columns)
    for c in dealt.columns:
        for a, b in zip(dealt[c], whole[c]):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, err_msg=c)


def test_lap_features_shuffle_read_traces_only(spark, tmp_path):
    line_items(spark, tmp_path)
    traces = T.lap_features(adapters.samples(spark, str(tmp_path))).select(*KEYS, "speed_trace")
    plan = traces._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(_t_speed" in plan and "collect_list(_t_brake" not in plan and "collect_list(_gear" not in plan


def test_mean_trace_of_uneven_traces(spark):
    nan = float("nan")
    rows = [(1, [1.0] * 11, [nan] * 11), (1, [3.0] * 17, [2.0]), (1, [], []), (1, None, [9.0]), (2, [], [])]
    df = spark.createDataFrame(rows, "driver_number int, a array<double>, b array<double>")
    means = T.mean_trace(df, ["driver_number"], ["a", "b"])
    assert "_piece" in means._jdf.queryExecution().analyzed().toString()
    got = {r.k: (r.driver_number, r.a, r.b) for r in means.collect()}
    assert got == {k: (1, 2.0 if k < 11 else 3.0, 2.0 if k == 0 else None) for k in range(17)}
