import random

import pytest
from pyspark.sql import functions as F

from lapspark.operators.sketches import merge_sketches, quantile_sketches, rank_deviation, rank_error, sketch_quantiles
from lapspark.session import shared_dir
from lapspark.streaming import live

QUANTILES = [0.0, 0.1, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = [(k, i % 7, rnd.choice([rnd.gauss(90, 5), 88.0])) for k, n in ((1, 20_000), (2, 300), (3, 1)) for i in range(n)]
    data += [(1, 0, float("nan")), (2, 0, None), (4, 0, None), (None, 0, 1.0)]
    return spark.createDataFrame(data, "session_key int, part int, v double").cache()


def test_estimates_within_the_bound(rows):
    found = sketch_quantiles(quantile_sketches(rows, ["session_key"], "v"), QUANTILES)
    by_key = {r.session_key: r for r in found.collect()}
    # Key 4 holds no value.
    assert {k: r.n for k, r in by_key.items()} == {1: 20_000, 2: 300, 3: 1, None: 1}
    assert len(set(by_key[3].estimates)) == 1
    off = rank_deviation(rows, ["session_key"], "v", found, QUANTILES).collect()
    assert len(off) == 15 and max(r.deviation for r in off) <= 2 * rank_error()


def test_merging_in_any_order(rows):
    parts = quantile_sketches(rows, ["session_key", "part"], "v")
    for order in (F.col("part"), F.desc("part"), F.hash("part")):
        found = sketch_quantiles(merge_sketches(parts.orderBy(order), ["session_key"]), QUANTILES)
        assert found.where("session_key = 1").head().n == 20_000
        assert rank_deviation(rows, ["session_key"], "v", found, QUANTILES).agg(F.max("deviation")).head()[0] <= 2 * rank_error()


def test_larger_sketches_are_closer():
    assert rank_error(4000) < rank_error(400) < rank_error(40) and rank_error(200) == pytest.approx(0.0133, abs=2e-4)


def test_stored_by_batch_and_replayed(spark, rows):
    landing, out = shared_dir(spark, "landing"), shared_dir(spark, "sketches")
    named = rows.where("session_key IS NOT NULL")
    named.repartition(4).write.parquet(landing)
    stream = live.stream_table(spark, landing, named.schema, files_per_batch=1)
    apply = live.store_sketches(out, "v")
    live.run_available(stream, apply, shared_dir(spark, "state"))
    # A second query over the same files has the same batch numbers and overwrites, it does not count twice.
    live.run_available(stream, apply, shared_dir(spark, "state"))
    found = live.live_quantiles(spark, out, QUANTILES)
    assert {r.session_key: r.n for r in found.collect()} == {1: 20_000, 2: 300, 3: 1}
    assert rank_deviation(named, ["session_key"], "v", found, QUANTILES).agg(F.max("deviation")).head()[0] <= 2 * rank_error()


def test_arguments(rows):
    with pytest.raises(ValueError):
        quantile_sketches(rows, ["session_key"], "v", 7)
    for wrong in ([], [1.5], [-0.1]):
        with pytest.raises(ValueError):
            sketch_quantiles(quantile_sketches(rows, ["session_key"], "v"), wrong)


def test_no_rows(rows):
    none = quantile_sketches(rows.limit(0), ["session_key"], "v")
    assert sketch_quantiles(none, QUANTILES).collect() == []
