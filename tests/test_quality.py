import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lapspark.functions import scalar
from lapspark.operators import audit as U
from lapspark.operators import profiles as R
from lapspark.operators import quality as Q
from lapspark.operators.laps import parse_driver_codes
from lapspark.schemas import LAPS, STYLE_FEATURES, ensure_columns


def run(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r for r in fn(df).orderBy("i").collect()]


def test_parse_critique(spark):
    texts = [
        json.dumps({"confidence": 8, "factual_errors": ["a"], "suggested_improvements": ["b"]}),
        json.dumps({"confidence": 99}), json.dumps({"confidence": -5}), json.dumps({}),
        json.dumps({"factual_errors": [str(i) for i in range(10)], "suggested_improvements": list("abcd")}),
        "nope", "", None, "[1]", json.dumps({"confidence": "x"}), json.dumps({"confidence": None}),
        json.dumps({"confidence": "7"}), json.dumps({"confidence": 6.9}), json.dumps({"factual_errors": "text"}),
        json.dumps({"confidence": True}),
    ]
    got = run(spark, Q.parse_critique, texts)
    assert [r.confidence for r in got] == [8, 10, 1, 10, 10, None, None, None, None, None, None, 7, 6, 10, 1]
    assert [r.error for r in got][5:11] == ["not json"] * 3 + ["not an object"] + ["bad confidence"] * 2
    assert got[4].factual_errors == ["0", "1", "2", "3", "4"] and got[4].suggested_improvements == ["a", "b", "c"]
    assert got[13].factual_errors == []


def report(**change):
    base = {
        "headline": "h", "strengths": ["a", "b", "c"], "weaknesses": ["a", "b"], "race_craft_rating": 8,
        "raw_pace_rating": 9, "consistency_rating": 7, "tactical_tips": ["a", "b"], "style_tags": ["a", "b", "c"],
    }
    base.update(change)
    return json.dumps({k: v for k, v in base.items() if v != "DROP"})


def test_validate_report(spark):
    texts = [
        report(), report(headline="DROP"), report(raw_pace_rating=11), report(strengths=["a"]),
        report(style_tags=list("abcdef")), report(headline="<b>x</b>", weaknesses=["<i>", "b"]), report(race_craft_rating="7"),
        report(race_craft_rating="x"), report(tactical_tips=["a", 2]), report(weaknesses="w"), report(headline=3), "bad",
        report(strengths=["a", "b", "c", 4]), report(race_craft_rating=7.9),
    ]
    got = run(spark, Q.validate_report, texts)
    assert [r.is_valid for r in got] == [True, False, False, False, True, True, True, False, False, False, False, False, True, True]
    assert [r.reason for r in got if not r.is_valid] == [
        "headline: missing", "raw_pace_rating: out of range", "strengths: too few items", "race_craft_rating: not an integer",
        "tactical_tips: item is not text", "weaknesses: not a list", "headline: not text", "not json",
    ]
    assert got[4].report.style_tags == list("abcde") and got[5].report.headline == "bx/b"
    assert got[5].report.weaknesses == ["i", "b"] and got[6].report.race_craft_rating == 7 and got[13].report.race_craft_rating == 7


def test_sanitize(spark):
    texts = ["  hi  ", "x" * 500, "x" * 501, "", "   ", "a\x00b\x1fc", "a\nb\tc", None, "\x01\x02z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r for r in Q.sanitize_text(df).orderBy("i").collect()]
    assert [r.cleaned for r in got][:2] == ["hi", "x" * 500]
    assert [r.error for r in got][2:5] == ["too long", "empty", "empty"]
    assert got[5].cleaned == "abc" and got[6].cleaned == "a\nb\tc" and got[8].cleaned == "z"


def test_clamp():
    assert [Q.clamp_argument(v, 2, 15) for v in (99, 0, None, "5")] == [15, 2, 2, 5]
    with pytest.raises(ValueError):
        Q.clamp_argument("many", 2, 15)
    assert parse_driver_codes(" ver, ham ,, nor") == ["VER", "HAM", "NOR"]


def test_bounds_and_membership(spark):
    df = spark.createDataFrame([("1", "100"), ("2", "NaN"), ("3", "abc"), ("4", "500"), ("5", None)], "i string, mean_speed string")
    got = {r.i: r.reason for r in Q.check_bounds(df, ["mean_speed"]).collect()}
    assert got == {
        "1": None, "2": "mean_speed: not finite", "3": "mean_speed: not numeric",
        "4": "mean_speed: outside [50.0, 380.0]", "5": "mean_speed: not numeric",
    }
    known = spark.createDataFrame([("1",), ("2",)], "i string")
    assert Q.check_membership(df, known, "i").count() == 3


def test_training_rows(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 1.0), (2.0, 3.0)], "mean_speed double, steer_std double")
    assert sorted(map(tuple, Q.training_rows(df, ["mean_speed", "steer_std"]).collect())) == [(1.0, 0.0), (2.0, 3.0)]


def test_ensure_columns(spark):
    df, missing = ensure_columns(spark.createDataFrame([(1, "x")], "driver_number int, extra string"), LAPS)
    assert "st_speed" in missing and "extra" in df.columns and df.schema["lap_duration"].dataType.simpleString() == "double"


def test_audit_cost(spark):
    log = spark.createDataFrame(
        [("a", 10.0, 1_000_000, 1_000_000, True), (None, None, None, None, None), ("a", 20.0, 0, 0, False)],
        "feature string, latency_ms double, prompt_tokens long, completion_tokens long, success boolean",
    )
    got = {r.feature: r for r in U.audit_cost(log).collect()}
    assert got["a"].estimated_cost_usd == pytest.approx(0.75) and got["a"].success_rate == 0.5
    assert got["a"].mean_latency_ms == 15.0 and got["unknown"].mean_latency_ms == 0.0 and got[None].calls == 3


def test_history(spark):
    rows = [(c, t, "x" * (2001 if t == 24 else 2000)) for c in (1, 2) for t in range(25)]
    got = U.cap_history(spark.createDataFrame(rows, "conv_id int, turn int, text string")).collect()
    assert len(got) == 40 and min(r.turn for r in got) == 5
    assert {len(r.text) for r in got if r.turn == 24} == {2012} and all(r.text.endswith("[truncated]") for r in got if r.turn == 24)


def test_rates(spark):
    rows = [("f", 1, 1, True), ("f", 2, 1, False), ("f", 2, 2, True), ("f", 3, 1, False), ("f", 3, 2, False), ("f", 4, 1, True)]
    r = U.compliance_rates(spark.createDataFrame(rows, "feature string, request_id int, attempt int, is_valid boolean")).collect()[0]
    assert (r.requests, r.first_pass_rate, r.retry_rate, r.failure_rate) == (4, 0.5, 0.25, 0.25)


def test_cosine(spark):
    names = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "name string, vector array<double>")
    asked = names.withColumnRenamed("name", "query_id")
    got = {(r.query_id, r["rank"]): (r.name, r.similarity) for r in R.cosine_topk(asked, names, 3).collect()}
    assert got[("a", 1)] == ("a", 1.0) and got[("a", 2)] == ("b", 0.0) and got[("z", 1)] == ("a", 0.0)
    in_blocks = {(r.query_id, r["rank"]): (r.name, r.similarity) for r in R.cosine_topk(asked, names, 3, block=1).collect()}
    assert in_blocks == got


def clustered(spark, clusters=12, each=60, width=16):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    near = lambda c: [x + rnd.gauss(0, 0.05) for x in c]
    rows = [(f"p{i:02d}-{j}", near(c)) for i, c in enumerate(centres) for j in range(each)]
    # A third of all profiles are copies of one vector; some are zero; some lie anywhere.
    rows += [(f"copy{j}", centres[0]) for j in range(clusters * each // 2)] + [("zero", [0.0] * width), ("zero2", [0.0] * width)]
    rows += [(f"far{j}", [rnd.gauss(0, 1) for _ in range(width)]) for j in range(20)]
    asked = [(k, near(centres[k % clusters])) for k in range(60)] + [(90, [0.0] * width), (91, [rnd.gauss(0, 1) for _ in range(width)])]
    return rows, asked


def test_bounds_leave_out_blocks_and_lose_no_hit(spark):
    rows, asked = clustered(spark)
    profiles = spark.createDataFrame(rows, "name string, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n >= 1e-9 else 0.0 for x in v]

    for k in (1, 3, 200):
        got = {}
        for r in R.cosine_topk(queries, profiles, k, block=80).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.name, r.similarity))
        for q, v in asked:
            scores = {n: sum(a * b for a, b in zip(unit(v), unit(w))) for n, w in rows}
            found = [s for _, _, s in sorted(got[q])]
            assert found == pytest.approx(sorted(scores.values(), reverse=True)[:k], abs=1e-12)
            assert len({n for _, n, _ in got[q]}) == k
            assert all(scores[n] == pytest.approx(s, abs=1e-12) for _, n, s in got[q])
    blocks = R.profile_blocks(profiles, 80)
    sizes = [r.n for r in blocks.select(F.size("_profiles").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 240
    asked_units = queries.where("query_id < 90").select("query_id", F.col("vector").alias("_q"))
    asked_units = asked_units.select("query_id", scalar.unit(F.col("_q")).alias("_q"))
    first, rest = R.bounded_hits(asked_units, blocks, ["name"], 2, "query_id")
    scored = sum(r[0] or 0 for part in (first, rest) for r in part.agg(F.sum("_scored")).collect())
    assert scored < 60 * len(rows) / 2


def test_search_odd_tables(spark):
    schema = "name string, vector array<double>"
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("n", None)], schema)
    asked = some.withColumnRenamed("name", "query_id").distinct()
    assert R.cosine_topk(asked, spark.createDataFrame([], schema), 2).count() == 0
    assert [(r["rank"], r.name, r.similarity) for r in R.cosine_topk(asked, some, 5).collect()] == [(1, "a", 1.0), (2, "a", 1.0)]
    repeated = spark.createDataFrame([("a", [1.0, 0.5])] * 150 + [("b", [0.0, 1.0])], schema)
    found = R.cosine_topk(asked, repeated, 151).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in found} == {"a": 150, "b": 1}
    for wrong in ({"k": 0}, {"block": 0}):
        with pytest.raises(ValueError):
            R.cosine_topk(asked, some, **wrong)


def test_built_in_profiles_find_themselves(spark):
    each, overall = R.retrieval_quality(R.style_profiles(spark))
    row = overall.collect()[0]
    assert row.n_profiles == 10 and row.self_match_rate == 1.0 and row.mean_retrieval_margin > 0
    assert each.where(F.abs(F.col("rank1_similarity") - 1) > 1e-9).count() == 0


def test_profiles(spark):
    rows = [(1, d, i, float(10 * d + i), 5.0, 1.0) for d in (1, 2) for i in (0, 2)]
    laps = spark.createDataFrame(rows, "session_key int, driver_number int, lap_number int, a double, b double, c double")
    got = {r.driver_number: r for r in R.normalised_profile(laps, ["a", "b"]).collect()}
    assert got[1].a == pytest.approx(1 / 12) and got[2].a == pytest.approx(11 / 12) and got[1].b == 0.0
    ranks = {(r.driver_number, r.lap_number): r.percentile for r in R.percentile_rank(laps, ["a"], ["driver_number", "lap_number"]).collect()}
    assert ranks == {(1, 0): 25.0, (1, 2): 50.0, (2, 0): 75.0, (2, 2): 100.0}
    spread = R.consistency_matrix(laps, ["a"]).collect()
    assert all(r.a == 0.0 for r in spread)


def test_archetypes(spark):
    nan = float("nan")
    cases = [
        ({"brake_events": 0.66, "brake_mean": 0.61}, "Aggressive Braker"),
        ({"trail_brake_score": 0.56, "steer_std": 0.61}, "Trail Braking Specialist"),
        ({"mean_speed": 0.71, "coasting_pct": 0.34}, "High Entry Speed"),
        ({"throttle_pickup_pct": 0.61, "throttle_std": 0.39}, "Smooth Operator"),
        ({"gear_changes": 0.66, "steer_std": 0.56}, "Technical Driver"),
        ({"brake_events": nan, "brake_mean": 0.9}, "Balanced Driver"),
        ({"mean_speed": 0.8, "coasting_pct": nan}, "Balanced Driver"),
    ]
    base = {f: 0.5 for f in STYLE_FEATURES}
    rows = [(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{f} double" for f in STYLE_FEATURES))
    got = [r.archetype for r in R.archetype(df).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    partial = spark.createDataFrame([(0.8,)], "mean_speed double")
    assert R.archetype(partial).collect()[0].archetype == "High Entry Speed"


def test_rating_tiers(spark):
    df = spark.createDataFrame([(9, 9, 8), (7, 7, 7), (5, 4, 5), (1, 2, 2), (3, 3, 3)], "race_craft_rating int, raw_pace_rating int, consistency_rating int")
    got = [(r.overall_rating, r.overall_tier) for r in R.rating_tier(df).collect()]
    assert got == [(8.7, "Elite"), (7.0, "Strong"), (4.7, "Good"), (1.7, "Below Average"), (3.0, "Average")]
