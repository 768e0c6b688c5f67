"""Exact top-k against numpy."""

import math
import random

import numpy as np

from lapspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q string, dim string"


def brute(vectors, k=10):
    clean = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    for i, v in clean.items():
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean.items() if j != i and len(v) == len(w))
            for rank, (s, j) in enumerate(scores[:k], 1):
                yield i, rank, j, -s


def check(spark, vectors, k=10, **more):
    df = spark.createDataFrame([(i, v, None, "a", "b", "c") for i, v in vectors], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, k, **more).collect())
    assert got == sorted(brute(vectors, k))


def test_against_numpy(spark):
    rnd = random.Random(1)
    vectors = [(i, [rnd.gauss(0, 0.3) for _ in range(8)]) for i in range(-120, 700)]
    check(spark, vectors, query_block=3, candidate_block=100)


def test_ties_odd_vectors_and_few_candidates(spark):
    same = [0.5, -0.25, 1.0]
    vectors = [(i, same) for i in range(150)] + [
        (200, None), (300, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]),
        (600, [1.0, 2.0]), (700, []), (601, [0.5, 2.0]), (None, same), (800, [0.0, 0.0, 0.0]), (900, [-3.0, 40.0, -500.0]),
    ]
    check(spark, vectors, query_block=2, candidate_block=20)
    check(spark, vectors[:4])


def test_large_components_stay_exact(spark):
    rnd = random.Random(2)
    check(spark, [(i, [rnd.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(0, 400, 5)], k=3)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty).collect() == []
    df = spark.createDataFrame([(0, [1.0], 1, None, None, None), (7, [2.0], 1, None, None, None)] * 2, SCHEMA)
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 7, 1024 * 2048)]


def pooled(vectors, k):
    """All distinct rows are candidates; the hits of one id are ranked together."""
    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in {(i, tuple(v)) for i, v in vectors}]
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        found = sorted(
            (-sum(a * b for a, b in zip(v, w)), j) for i, v in rows if i == q for j, w in rows if j != q and len(v) == len(w))
        for rank, (minus, j) in enumerate(found[:k], 1):
            yield q, rank, j, max(-(1 << 63), min((1 << 63) - 1, -minus))


def check_pooled(spark, vectors, k, **more):
    df = spark.createDataFrame([(i, list(v)) for i, v in vectors], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, k, **more).collect()) == sorted(pooled(vectors, k))


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    check_pooled(spark, [(0, [1.0]), (7, [2.0]), (7, [3.0]), (100, [0.5])], 10)
    rnd = random.Random(3)
    # One id holds a third of all rows, another one several query vectors.
    ids = [7] * 100 + [200] * 5 + list(range(195))
    check_pooled(spark, [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in ids], 6, query_block=2, candidate_block=16)


def test_components_beyond_64_bit_scores(spark):
    rnd = random.Random(4)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(0, 300, 5)]
    vectors += [(500, [1e7, -1.0, 2.0]), (501, [-1e7, 3e7, 0.0]), (502, [2e6, 2e6, 2e6]), (600, [3e12, 1.0, -4e9]), (601, [3e12, 2.0, 4e9])]
    check_pooled(spark, vectors, 4, candidate_block=20)
    check_pooled(spark, [(0, [4e7]), (1, [5e7])], 4)


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """Copies of the query blocks grow with queries times candidates; a broadcast would bring them to the driver."""
    plans, scored = [], topk._scored

    def watched(pairs, *more):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return scored(pairs, *more)

    monkeypatch.setattr(topk, "_scored", watched)
    monkeypatch.setattr(topk, "GROUP", 2)
    rnd = random.Random(5)
    check(spark, [(i, [rnd.gauss(0, 0.3) for _ in range(4)]) for i in range(900)], query_block=2, candidate_block=10)
    assert len(plans) > 1 and not any("Broadcast" in plan for plan in plans)
