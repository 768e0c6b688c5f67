"""Cross-checks of the ordered primitives against pandas, with buckets small enough to be crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapspark.functions.scalar import sequence_bucket, time_bucket, value_bucket
from lapspark.operators.joins import interval_join
from lapspark.operators.ordered import (
    asof_backward,
    exploded_range,
    first_rows,
    rolling_mean,
    row_number_in_order,
    with_neighbours,
    with_running,
)
from lapspark.operators.quantiles import grouped_median, value_percentile

pytestmark = pytest.mark.usefixtures("tiny_buckets")


@pytest.fixture()
def hot(spark):
    """One key holds most rows; its order values are sparse."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(400) < 0.7, 1, rng.integers(2, 6, 400))
    pdf = pd.DataFrame({"k": key, "v": rng.normal(90, 5, 400).round(3)})
    pdf["o"] = pdf.groupby("k")["v"].transform(lambda s: np.cumsum(rng.integers(1, 9, len(s))))
    pdf.loc[rng.random(400) < 0.2, "w"] = 1.5
    pdf["w"] = pdf["w"] * pdf["v"]
    sdf = spark.createDataFrame(pdf).withColumn("w", F.nanvl("w", F.lit(None).cast("double")))
    return pdf.sort_values(["k", "o"]).reset_index(drop=True), sdf


def ordered(df, *cols):
    return df.toPandas().sort_values(["k", "o"]).reset_index(drop=True)[list(cols)]


def test_running(hot):
    pdf, sdf = hot
    out = with_running(sdf, ["k"], ["o"], sequence_bucket("o"), sums={"s": F.col("v")}, lasts={"l": F.col("w")})
    got = ordered(out, "s", "l")
    np.testing.assert_allclose(got["s"], pdf.groupby("k")["v"].cumsum())
    np.testing.assert_allclose(got["l"].astype(float), pdf.groupby("k")["w"].ffill())
    n = ordered(row_number_in_order(sdf, ["k"], ["v", "o"], value_bucket("v"), "n"), "n")["n"]
    want = pdf.sort_values(["k", "v", "o"]).groupby("k").cumcount() + 1
    assert n.tolist() == want.sort_index().tolist()


def test_neighbours(hot):
    pdf, sdf = hot
    out = with_neighbours(
        sdf, ["k"], ["o"], sequence_bucket("o"), lag={"p": F.col("w")}, lead={"n": F.col("v")},
        first={"f": F.col("v")}, last={"z": F.col("v")}, rows_name="size",
    )
    got = ordered(out, "p", "n", "f", "z", "size", "_has_lag", "_has_lead")
    g = pdf.groupby("k")
    np.testing.assert_allclose(got["p"].astype(float), g["w"].shift(1))
    np.testing.assert_allclose(got["n"].astype(float), g["v"].shift(-1))
    np.testing.assert_allclose(got["f"], g["v"].transform("first"))
    np.testing.assert_allclose(got["z"], g["v"].transform("last"))
    assert got["size"].tolist() == g["v"].transform("size").tolist()
    assert (~got["_has_lag"]).sum() == (~got["_has_lead"]).sum() == pdf["k"].nunique()


@pytest.mark.parametrize(("window", "least"), [(1, 1), (2, 2), (5, 1), (5, 5), (40, 7)])
def test_rolling_mean(hot, window, least):
    pdf, sdf = hot
    out = ordered(rolling_mean(sdf, ["k"], ["o"], sequence_bucket("o"), "v", "m", window, least), "m")
    want = pdf.groupby("k")["v"].transform(lambda s: s.rolling(window, min_periods=least).mean())
    np.testing.assert_allclose(out["m"].astype(float), want)


def test_asof(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2026-01-01")
    left = pd.DataFrame({"by": rng.integers(0, 3, 200), "on": base + pd.to_timedelta(rng.choice(5000, 200, False), "s")})
    left["x"] = range(200)
    right = pd.DataFrame({"by": rng.integers(0, 3, 60), "on": base + pd.to_timedelta(rng.choice(5000, 60, False), "s")})
    right["y"] = range(60)
    right.loc[0, ["by", "on"]] = left.loc[0, ["by", "on"]].values  # an exact hit counts
    want = pd.merge_asof(left.sort_values("on"), right.sort_values("on"), on="on", by="by").sort_values("x")
    got = asof_backward(
        spark.createDataFrame(left), spark.createDataFrame(right), ["by"], "on", ["y"], lambda c: time_bucket(c, 30)
    ).toPandas().sort_values("x")
    assert len(got) == 200
    np.testing.assert_allclose(got["y"].astype(float), want["y"])


def test_interval_join(spark):
    rng = np.random.default_rng(7)
    points = pd.DataFrame({"k": rng.integers(0, 3, 300), "p": rng.integers(-50, 3000, 300)})
    spans = pd.DataFrame({"k": rng.integers(0, 3, 80), "a": rng.integers(-60, 3000, 80)})
    spans["b"] = spans["a"] + rng.choice([0, 1, 31, 32, 33, 400, 1024, 1025, 10**8], 80)
    spans["id"] = range(80)
    want = points.merge(spans, on="k").query("a <= p <= b")
    got = interval_join(spark.createDataFrame(points), spark.createDataFrame(spans), ["k"], "p", "a", "b").toPandas()
    key = ["k", "p", "id"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_median_and_percentile(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": np.where(rng.random(501) < 0.8, 1, rng.integers(2, 9, 501))})
    pdf["v"] = rng.choice([rng.normal(0, 50), *rng.normal(90, 30, 40).round(1), -3.0, 0.0], 501)
    sdf = spark.createDataFrame(pdf)
    got = grouped_median(sdf, ["k"], "v", "m").toPandas().set_index("k")["m"].sort_index()
    np.testing.assert_allclose(got, pdf.groupby("k")["v"].median())
    ranks = value_percentile(sdf, ["k"], "v", "p").toPandas()
    for r in ranks.itertuples():
        group = pdf.loc[pdf["k"] == r.k, "v"]
        assert r.p == pytest.approx((group <= r.v).mean() * 100)


def test_value_bucket_is_monotone(spark):
    values = sorted([-1e12, -3.5, -1e-9, 0.0, 1e-9, 0.5, 2.0, 1e6, 1e300, float("inf"), float("-inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket("v").alias("b"))
    buckets = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert buckets == sorted(buckets)


def test_first_rows_of_any_number(spark):
    rnd = np.random.default_rng(5)
    rows = [(int(k) or None, int(o) or None, float(v)) for k, o, v in zip(rnd.integers(0, 3, 3000), rnd.integers(0, 900, 3000), rnd.random(3000))]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    order = [F.desc("o"), F.desc("v")]
    for n in (1, 40, 1200):
        got = first_rows(df, ["k"], order, n, sequence_bucket("o", descending=True), "at").collect()
        want = {}
        for k in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)
            want |= {r: i + 1 for i, r in enumerate(mine[:n])}
        assert {(r.k, r.o, r.v): r["at"] for r in got} == want and len(got) == len(want)


def test_last_laps_on_both_sides_of_the_limit(spark, monkeypatch):
    from lapspark.operators import laps

    rows = [(1, d, i, 90.0 + i % 7, False, None) for d in (1, 2) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "session_key int, driver_number int, lap_number int, lap_duration double, is_pit_out_lap boolean, date timestamp")
    plain = sorted(map(str, laps.last_laps(df, 20).collect()))
    monkeypatch.setattr(laps, "GROUP_LIMIT", 10)
    assert sorted(map(str, laps.last_laps(df, 20).collect())) == plain and len(plain) == 40
    with pytest.raises(ValueError):
        laps.last_laps(df, 0)


def test_ranges_longer_than_a_piece(spark):
    rows = [(1, 1, 25), (2, 3, 3), (3, 5, 4), (4, 1, 10), (5, None, 3)]
    df = spark.createDataFrame(rows, "k int, a int, z int")
    got = sorted((r.k, r.i) for r in exploded_range(df, F.col("a"), F.col("z"), "i", piece=10).collect())
    assert got == [(k, i) for k, a, z in rows if a for i in range(a, z + 1)]
