"""Quality, retrieval, audit, classification and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapspark.operators import audit as U
from lapspark.operators import laps as L
from lapspark.operators import ml as M
from lapspark.operators import profiles as R
from lapspark.operators import quality as Q
from lapspark.operators import sketches as K
from lapspark.plans.race import CUMULATIVE, LAPS, POSITION, ROLLING, STINTS
from lapspark.plans.registry import ORACLES, query
from lapspark.plans.telemetry import FASTEST
from lapspark.schemas import ARGUMENT_LIMITS
from lapspark.schemas import CAR_DATA as CAR_SCHEMA
from lapspark.schemas import LAPS as LAP_SCHEMA
from lapspark.schemas import POSITION as POSITION_SCHEMA
from lapspark.schemas import STINTS as STINT_SCHEMA
from lapspark.schemas import ensure_columns
from lapspark.session import materialize, remove_folder, scratch_tables, shared_dir, shuffles_removed
from lapspark.sources import adapters as A
from lapspark.sources import quarantine, tables
from lapspark.streaming import keyed, live

PROFILES = """profiles AS (
  SELECT 'profile ' || label AS name, list(m ORDER BY i) AS vector FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2)
  GROUP BY 1)"""


@query("cosine_topk", f"""WITH {PROFILES},
scored AS (
  SELECT vec_id AS query_id, name, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector) AS similarity
  FROM embeddings, profiles)
SELECT query_id, rank, name, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, name) AS rank FROM scored)
WHERE rank <= 2""")
def cosine_topk(spark, sf):
    return R.cosine_topk(A.queries(spark, sf), A.profiles(spark, sf), 2)


RETRIEVAL = f"""{PROFILES},
scored AS (
  SELECT a.name AS profile, b.name, list_cosine_similarity(a.vector, b.vector) AS similarity
  FROM profiles a, profiles b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY profile ORDER BY similarity DESC, name) AS rank FROM scored),
each AS (
  SELECT profile, max(name) FILTER (WHERE rank = 1) AS rank1_match,
         max(similarity) FILTER (WHERE rank = 1) AS rank1_similarity,
         max(name) FILTER (WHERE rank = 2) AS rank2_match,
         max(similarity) FILTER (WHERE rank = 2) AS rank2_similarity FROM ranked GROUP BY 1)"""


@query("retrieval_quality", f"""WITH {RETRIEVAL}
SELECT profile, rank1_match, round(rank1_similarity, 6) AS rank1_similarity, rank2_match,
       round(rank2_similarity, 6) AS rank2_similarity, rank1_match = profile AS self_match,
       round(rank1_similarity - rank2_similarity, 6) AS retrieval_margin FROM each""")
def retrieval_quality(spark, sf):
    return R.retrieval_quality(A.profiles(spark, sf))[0]


@query("retrieval_summary", f"""WITH {RETRIEVAL}
SELECT count(*) AS n_profiles, avg(CASE WHEN rank1_match = profile THEN 1.0 ELSE 0.0 END) AS self_match_rate,
       round(avg(rank1_similarity - rank2_similarity), 6) AS mean_retrieval_margin FROM each""")
def retrieval_summary(spark, sf):
    return R.retrieval_quality(A.profiles(spark, sf))[1]


@query("check_bounds", """WITH c AS (
  SELECT c_custkey, c_acctbal / 10 AS mean_speed,
         CASE c_nationkey WHEN 3 THEN 'NaN' WHEN 4 THEN 'abc' WHEN 5 THEN 'Infinity'
              ELSE CAST(c_nationkey * 10 AS VARCHAR) END AS brake_events FROM customer),
n AS (SELECT *, try_cast(brake_events AS DOUBLE) AS b FROM c),
r AS (SELECT c_custkey,
  CASE WHEN NOT isfinite(mean_speed) THEN 'mean_speed: not finite'
       WHEN mean_speed NOT BETWEEN 50 AND 380 THEN 'mean_speed: outside [50.0, 380.0]'
       WHEN b IS NULL THEN 'brake_events: not numeric'
       WHEN NOT isfinite(b) THEN 'brake_events: not finite'
       WHEN b NOT BETWEEN 0 AND 200 THEN 'brake_events: outside [0.0, 200.0]' END AS reason FROM n)
SELECT c_custkey, reason, reason IS NULL AS is_valid FROM r""")
def check_bounds(spark, sf):
    text = (
        F.when(F.col("c_nationkey") == 3, "NaN").when(F.col("c_nationkey") == 4, "abc")
        .when(F.col("c_nationkey") == 5, "Infinity").otherwise((F.col("c_nationkey") * 10).cast("string"))
    )
    rows = A.table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 10).alias("mean_speed"), text.alias("brake_events")
    )
    return Q.check_bounds(rows, ["mean_speed", "brake_events"]).select("c_custkey", "reason", "is_valid")


@query("check_membership", """SELECT event_id, user_id AS driver_number FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def check_membership(spark, sf):
    events = A.table(spark, sf, "events").select("event_id", F.col("user_id").alias("driver_number"))
    known = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver_number"))
    return Q.check_membership(events, known, "driver_number")


@query("training_rows", """SELECT o_orderkey, o_totalprice AS mean_speed,
       coalesce(CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END, 0.0) AS steer_std
FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice IS NOT NULL""")
def training_rows(spark, sf):
    orders = A.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(float("nan")).alias("mean_speed"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("double")).alias("steer_std"),
    )
    return Q.training_rows(orders, ["mean_speed", "steer_std"])


@query("ensure_columns", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date,
       CAST(NULL AS BIGINT) AS st_speed, CAST(NULL AS TIMESTAMP) AS date_start FROM laps""")
def required_columns(spark, sf):
    return ensure_columns(A.laps(spark, sf), LAP_SCHEMA)[0]


CRITIQUES = f"""c AS (SELECT conv_id, turn, role AS feature, {A.CRITIQUE_JSON} AS response FROM conversations),
j AS (SELECT *, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS doc FROM c),
t AS (SELECT *, json_type(doc, '$.confidence') AS kind, doc ->> '$.confidence' AS raw FROM j),
v AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN try_cast(raw AS BIGINT) END
                     WHEN kind IS NOT NULL THEN CAST(trunc(try_cast(raw AS DOUBLE)) AS BIGINT) END AS n FROM t),
critiques AS (
  SELECT conv_id, turn, feature,
    CASE WHEN doc IS NULL THEN 'not json' WHEN json_type(doc) <> 'OBJECT' THEN 'not an object'
         WHEN kind IS NOT NULL AND n IS NULL THEN 'bad confidence' END AS error,
    greatest(1, least(10, CASE WHEN kind IS NULL THEN 10 ELSE n END)) AS confidence,
    CASE WHEN json_type(doc, '$.factual_errors') = 'ARRAY'
         THEN list_slice(CAST(doc -> '$.factual_errors' AS VARCHAR[]), 1, 5) ELSE [] END AS factual_errors,
    CASE WHEN json_type(doc, '$.suggested_improvements') = 'ARRAY'
         THEN list_slice(CAST(doc -> '$.suggested_improvements' AS VARCHAR[]), 1, 3) ELSE [] END AS suggested
  FROM v)"""


@query("parse_critique", f"""WITH {CRITIQUES}
SELECT conv_id, turn, feature, error, CASE WHEN error IS NULL THEN confidence END AS confidence,
       CASE WHEN error IS NULL THEN array_to_string(factual_errors, '|') END AS factual_errors,
       CASE WHEN error IS NULL THEN array_to_string(suggested, '|') END AS suggested_improvements FROM critiques""")
def parse_critique(spark, sf):
    rows = Q.parse_critique(A.critiques(spark, sf))
    return rows.select(
        "conv_id", "turn", "feature", "error", "confidence",
        F.array_join("factual_errors", "|").alias("factual_errors"),
        F.array_join("suggested_improvements", "|").alias("suggested_improvements"),
    )


@query("critique_quality", f"""WITH {CRITIQUES}
SELECT feature, count(*) AS critiques, round(avg(confidence), 9) AS mean_confidence,
       round(avg(CASE WHEN confidence < 7 THEN 1.0 ELSE 0.0 END), 9) AS revision_rate,
       round(avg(len(factual_errors)), 9) AS mean_factual_errors
FROM critiques WHERE error IS NULL GROUP BY 1""", digits=9)
def critique_quality(spark, sf):
    return U.critique_quality(Q.parse_critique(A.critiques(spark, sf)))


def _list_rule(name: str, least: int, keep: int, later: str) -> str:
    items = f"CAST(doc -> '$.{name}' AS JSON[])"
    return f"""CASE WHEN json_type(doc, '$.{name}') IS NULL THEN '{name}: missing'
      WHEN json_type(doc, '$.{name}') <> 'ARRAY' THEN '{name}: not a list'
      WHEN json_array_length(doc, '$.{name}') < {least} THEN '{name}: too few items'
      WHEN len(list_filter(list_slice({items}, 1, {keep}), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN '{name}: item is not text'
      ELSE {later} END"""


def _rating_rule(name: str, later: str) -> str:
    return f"""CASE WHEN json_type(doc, '$.{name}') IS NULL THEN '{name}: missing'
      WHEN try_cast(doc ->> '$.{name}' AS BIGINT) IS NULL THEN '{name}: not an integer'
      WHEN CAST(doc ->> '$.{name}' AS BIGINT) NOT BETWEEN 1 AND 10 THEN '{name}: out of range' ELSE {later} END"""


_RULES = "NULL"
for _name, _kind, _lo, _hi in reversed(Q.REPORT_FIELDS):
    if _kind == "list":
        _RULES = _list_rule(_name, _lo, _hi, _RULES)
    elif _kind == "integer":
        _RULES = _rating_rule(_name, _RULES)
    else:
        _RULES = f"""CASE WHEN json_type(doc, '$.{_name}') IS NULL THEN '{_name}: missing'
      WHEN json_type(doc, '$.{_name}') <> 'VARCHAR' THEN '{_name}: not text' ELSE {_RULES} END"""
_RULES = f"CASE WHEN doc IS NULL THEN 'not json' WHEN json_type(doc) <> 'OBJECT' THEN 'not an object' ELSE {_RULES} END"

REPORTS = f"""j AS (SELECT conv_id, turn, try_cast({A.REPORT_JSON} AS JSON) AS doc FROM conversations),
checked AS (SELECT *, {_RULES} AS reason FROM j)"""


@query("validate_report", f"""WITH {REPORTS}
SELECT conv_id, turn, reason, reason IS NULL AS is_valid,
       CASE WHEN reason IS NULL THEN translate(doc ->> '$.headline', '<>', '') END AS headline,
       CASE WHEN reason IS NULL THEN translate(array_to_string(list_slice(CAST(doc -> '$.strengths' AS VARCHAR[]), 1, 3), '|'), '<>', '') END AS strengths,
       CASE WHEN reason IS NULL THEN array_to_string(list_slice(CAST(doc -> '$.style_tags' AS VARCHAR[]), 1, 5), '|') END AS style_tags,
       CASE WHEN reason IS NULL THEN CAST(doc ->> '$.raw_pace_rating' AS BIGINT) END AS raw_pace_rating FROM checked""")
def validate_report(spark, sf):
    rows = Q.validate_report(A.reports(spark, sf))
    return rows.select(
        "conv_id", "turn", "reason", "is_valid", "report.headline",
        F.array_join("report.strengths", "|").alias("strengths"),
        F.array_join("report.style_tags", "|").alias("style_tags"),
        "report.raw_pace_rating",
    )


@query("rating_tier", f"""WITH {REPORTS},
r AS (SELECT conv_id, turn, round_even((CAST(doc ->> '$.race_craft_rating' AS DOUBLE) + CAST(doc ->> '$.raw_pace_rating' AS DOUBLE)
             + CAST(doc ->> '$.consistency_rating' AS DOUBLE)) / 3, 1) AS overall_rating FROM checked WHERE reason IS NULL)
SELECT *, CASE WHEN round_even(overall_rating, 0) >= 9 THEN 'Elite' WHEN round_even(overall_rating, 0) >= 7 THEN 'Strong'
       WHEN round_even(overall_rating, 0) >= 5 THEN 'Good' WHEN round_even(overall_rating, 0) >= 3 THEN 'Average'
       ELSE 'Below Average' END AS overall_tier FROM r""")
def rating_tier(spark, sf):
    valid = Q.validate_report(A.reports(spark, sf)).where("is_valid").select("conv_id", "turn", "report.*")
    return R.rating_tier(valid).select("conv_id", "turn", "overall_rating", "overall_tier")


@query("compliance_rates", f"""WITH {REPORTS},
a AS (SELECT conv_id AS request_id, turn % 2 + 1 AS attempt, reason IS NULL AS ok FROM checked),
p AS (SELECT request_id, max(CASE WHEN attempt = 1 AND ok THEN 1 ELSE 0 END) AS f,
             max(CASE WHEN attempt = 2 AND ok THEN 1 ELSE 0 END) AS s FROM a GROUP BY 1)
SELECT 'report' AS feature, count(*) AS requests, round(avg(f), 9) AS first_pass_rate,
       round(avg(CASE WHEN f = 0 AND s = 1 THEN 1.0 ELSE 0.0 END), 9) AS retry_rate,
       round(avg(CASE WHEN f = 0 AND s = 0 THEN 1.0 ELSE 0.0 END), 9) AS failure_rate FROM p""", digits=9)
def compliance_rates(spark, sf):
    attempts = Q.validate_report(A.reports(spark, sf)).select(
        F.lit("report").alias("feature"), F.col("conv_id").alias("request_id"),
        (F.col("turn") % 2 + 1).alias("attempt"), "is_valid",
    )
    return U.compliance_rates(attempts)


@query("sanitize_text", r"""WITH t AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\pZ]+', ''),
                                       '[\s\x0B\x1C-\x1F\x{85}\pZ]+$', '') AS trimmed FROM conversations),
e AS (SELECT *, regexp_replace(trimmed, '[\x00-\x08\x0B-\x1F]', '', 'g') AS cleaned FROM t),
r AS (SELECT *, CASE WHEN length(trimmed) = 0 THEN 'empty' WHEN length(trimmed) > 500 THEN 'too long'
                     WHEN length(cleaned) = 0 THEN 'only control characters' END AS error FROM e)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN cleaned ELSE '' END AS cleaned FROM r""")
def sanitize_text(spark, sf):
    return Q.sanitize_text(A.table(spark, sf, "conversations")).select("conv_id", "turn", "error", "cleaned")


@query("cap_history", """SELECT source, doc_id,
       CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || ' [truncated]' ELSE text END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 20""")
def cap_history(spark, sf):
    documents = A.table(spark, sf, "documents").select("source", "doc_id", "text")
    return U.cap_history(documents, "source", "doc_id", "text")


AUDIT = """log AS (
  SELECT CASE WHEN event_type <> 'signup' THEN event_type END AS feature, value AS latency_ms,
         CAST(props ->> '$.k' AS BIGINT) AS p, event_id % 500 AS c, event_type <> 'error' AS success FROM events)"""


@query("audit_cost", f"""WITH {AUDIT}
SELECT coalesce(feature, 'unknown') AS feature, count(*) AS calls,
       round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 9) AS success_rate, round(avg(latency_ms), 9) AS mean_latency_ms,
       CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
       round(sum(p) / 1000000.0 * 0.15 + sum(c) / 1000000.0 * 0.60, 9) AS estimated_cost_usd FROM log GROUP BY feature
UNION ALL
SELECT NULL, count(*), round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 9), round(avg(latency_ms), 9),
       CAST(sum(p) AS BIGINT), CAST(sum(c) AS BIGINT), round(sum(p) / 1000000.0 * 0.15 + sum(c) / 1000000.0 * 0.60, 9) FROM log""", digits=9)
def audit_cost(spark, sf):
    return U.audit_cost(A.audit_log(spark, sf))


@query("audit_log_file", f"""WITH {AUDIT} SELECT feature, round(latency_ms, 6) AS latency_ms, p AS prompt_tokens,
       c AS completion_tokens, success FROM log""")
def audit_log_file(spark, sf):
    """Append to a JSON-lines log, then read it back tolerating damaged lines."""
    path = shared_dir(spark, "audit")
    tables.append_audit_log(A.audit_log(spark, sf), path)
    spark.createDataFrame([("",), ("{broken",)], "value string").write.mode("append").text(path)
    rows = tables.read_audit_log(spark, path).where(F.col("ts").isNotNull())
    return rows.select("feature", "latency_ms", "prompt_tokens", "completion_tokens", "success")


@query("session_label", """SELECT o_orderkey AS session_key, o_orderstatus AS session_type,
       CASE o_orderstatus WHEN 'R' THEN 'Race' WHEN 'Q' THEN 'Qualifying' WHEN 'S' THEN 'Sprint' ELSE o_orderstatus END AS session_label
FROM orders""")
def session_label(spark, sf):
    rows = A.sessions(spark, sf).select("session_key", "session_type")
    return rows.withColumn("session_label", tables.session_label(F.col("session_type")))


@query("missing_outlines", """SELECT n_name AS gp_name FROM nation
WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)""")
def missing_outlines(spark, sf):
    rich = A.table(spark, sf, "customer").where("c_acctbal > 9990").select("c_nationkey")
    nations = A.table(spark, sf, "nation")
    stored = nations.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    names = nations.select(F.col("n_name").alias("gp_name"))
    return tables.missing_outlines(names, stored.select(F.col("n_name").alias("gp_name")))


# --- classification ---

PREDICTIONS = """p AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS predicted FROM labels)"""


def _predictions(spark, sf):
    return A.table(spark, sf, "labels").select(
        F.col("quality").cast("string").alias("label"), F.col("toxic").cast("string").alias("predicted")
    )


@query("confusion_matrix", f"""WITH {PREDICTIONS}
SELECT label AS actual, predicted, count(*) AS n FROM p GROUP BY 1, 2""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_predictions(spark, sf))


@query("class_metrics", f"""WITH {PREDICTIONS},
c AS (SELECT c.label AS class, (SELECT count(*) FROM p WHERE p.label = c.label) AS support,
             (SELECT count(*) FROM p WHERE p.predicted = c.label) AS called,
             (SELECT count(*) FROM p WHERE p.label = c.label AND p.predicted = c.label) AS tp
      FROM (SELECT label FROM p UNION SELECT predicted FROM p) c),
m AS (SELECT class, support, CASE WHEN called > 0 THEN tp / called ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score,
       CASE WHEN f1 >= 0.90 THEN 'high' WHEN f1 >= 0.70 THEN 'medium' ELSE 'low' END AS f1_band FROM f""")
def class_metrics(spark, sf):
    return M.class_metrics(_predictions(spark, sf))


@query("metrics_store", f"""WITH {PREDICTIONS}
SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_samples FROM p""")
def metrics_store(spark, sf):
    path = shared_dir(spark, "metrics")
    scores = M.accuracy(_predictions(spark, sf))
    tables.write_metrics(scores, path)
    return tables.read_metrics(spark, path, scores.schema)


BLOCKS = [f"block_{i}" for i in range(8)]


def _labelled(spark, sf):
    """Ten features per embedding: eight block means, the overall mean and the squared norm."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    blocks = {b: total(F.slice(v, 8 * i + 1, 8)) / 8 for i, b in enumerate(BLOCKS)}
    rows = A.table(spark, sf, "embeddings").withColumns(
        {**blocks, "overall": total(v) / 64, "norm2": total(F.transform(v, lambda x: x * x))}
    )
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), *FEATURES)


FEATURES = [*BLOCKS, "overall", "norm2"]


@query("class_probabilities")
def class_probabilities(spark, sf):
    """Ranked class probabilities of every row from a saved and reloaded model."""
    rows = _labelled(spark, sf)
    path = shared_dir(spark, "model")
    M.save_model(M.train_classifier(rows, FEATURES), path)
    return M.class_probabilities(M.load_model(path), rows, "id")


@query("stratified_fold_sizes", """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT CAST(label AS VARCHAR) AS label, f.fold, CAST((n - f.fold + 4) // 5 AS BIGINT) AS rows
FROM n, range(0, 5) f(fold)""")
def stratified_fold_sizes(spark, sf):
    folds = M.stratified_folds(_labelled(spark, sf))
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("cross_validate")
def cross_validate(spark, sf):
    return M.cross_validate(_labelled(spark, sf), FEATURES)


@query("class_probability_invariants", """SELECT vec_id AS id, (SELECT count(DISTINCT label) FROM embeddings) AS classes,
       1.0 AS total, true AS ranked, true AS falling FROM embeddings""")
def class_probability_invariants(spark, sf):
    """Every row has each class once, ranks 1..n by falling probability, and probabilities that sum to 1."""
    by_rank = F.sort_array(F.collect_list(F.struct("rank", "probability", "class"))).alias("p")
    rows = class_probabilities(spark, sf).groupBy("id").agg(by_rank)
    falling = F.array_sort(F.transform("p", lambda x: -x["probability"]))
    return rows.select(
        "id", F.size(F.array_distinct(F.col("p.class"))).alias("classes"),
        F.aggregate("p", F.lit(0.0), lambda s, x: s + x["probability"]).alias("total"),
        (F.col("p.rank") == F.sequence(F.lit(1), F.size("p"))).alias("ranked"),
        (falling == F.transform("p", lambda x: -x["probability"])).alias("falling"),
    )


@query("cross_validate_invariants", """SELECT range AS fold, true AS in_range, true AS centred, true AS spread
FROM range(0, 5)""")
def cross_validate_invariants(spark, sf):
    """Accuracies between 0 and 1; the mean and the population deviation are those of the folds."""
    rows = cross_validate(spark, sf)
    told = rows.agg(F.avg("accuracy").alias("m"), F.stddev_pop("accuracy").alias("s"))
    mean, deviation = told.select("m").scalar(), told.select("s").scalar()
    return rows.select(
        "fold", F.col("accuracy").between(0, 1).alias("in_range"),
        ((F.abs(F.col("cv_mean") - mean) < 1e-9) & (F.abs(F.col("delta") - F.col("accuracy") + mean) < 1e-9)).alias("centred"),
        (F.abs(F.col("cv_std") - deviation) < 1e-9).alias("spread"),
    )


@query("feature_importance_invariants", f"""SELECT unnest([{', '.join(f"'{f}'" for f in sorted([*BLOCKS, 'overall', 'norm2']))}]) AS feature,
       true AS in_range""")
def feature_importance_invariants(spark, sf):
    """One importance for each feature, an accuracy difference."""
    return feature_importance(spark, sf).select("feature", F.col("importance").between(-1, 1).alias("in_range"))


@query("shapley_invariants", """SELECT vec_id AS id, 10 AS features, true AS adds_up, true AS ranked FROM embeddings""")
def shapley_invariants(spark, sf):
    """The attributions of a row add up to its probability minus the mean probability of its background rows."""
    rows = shapley_sample(spark, sf).groupBy("id").agg(
        F.count_distinct("feature").alias("features"), F.sum("attribution").alias("_sum"),
        F.max("own_probability").alias("_own"), F.max("background_probability").alias("_background"),
        F.sort_array(F.collect_list("rank")).alias("_ranks"),
    )
    return rows.select(
        "id", "features", (F.abs(F.col("_sum") - F.col("_own") + F.col("_background")) < 1e-9).alias("adds_up"),
        (F.col("_ranks") == F.sequence(F.lit(1), F.size("_ranks"))).alias("ranked"),
    )


@query("check_arguments", """WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(c_custkey % 40 - 5 AS VARCHAR)
       ELSE c_mktsegment END AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer),
e AS (SELECT c_custkey, b, CASE WHEN a IS NOT NULL AND try_cast(a AS INTEGER) IS NULL THEN 'window must be int, got ' || a END AS error,
      try_cast(a AS INTEGER) AS a FROM r)
SELECT c_custkey, error, CASE WHEN error IS NULL THEN greatest(2, least(15, coalesce(a, 2))) END AS window,
       CASE WHEN error IS NULL THEN greatest(1, least(20, CAST(b AS INTEGER))) END AS top_n FROM e""")
def check_arguments(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") % 40 - 5).cast("string")).when(
        F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))
    requests = A.table(spark, sf, "customer").select(
        "c_custkey", raw.alias("window"), F.col("c_nationkey").cast("string").alias("top_n"))
    return Q.check_arguments(requests, {k: ARGUMENT_LIMITS[k] for k in ("window", "top_n")})


@query("stored_class_metrics", ORACLES["class_metrics"])
def stored_class_metrics(spark, sf):
    """Per-class rows written to the metrics store and read back whole."""
    path = shared_dir(spark, "class-metrics")
    rows = M.class_metrics(_predictions(spark, sf))
    tables.write_metrics(rows, path)
    return tables.read_metrics(spark, path, rows.schema)


@query("feature_importance")
def feature_importance(spark, sf):
    rows = _labelled(spark, sf)
    return M.feature_importance(M.train_classifier(rows, FEATURES), rows, FEATURES)


@query("shapley_sample")
def shapley_sample(spark, sf):
    rows = _labelled(spark, sf)
    return M.shapley_sample(M.train_classifier(rows, FEATURES), rows, rows, FEATURES)


# --- streaming, run over everything available ---


@query("stream_deduplicate", """SELECT user_id % 5 AS session_key, user_id AS driver_number, count(*) AS reports,
       max(ts) AS newest FROM events GROUP BY 1, 2""")
def stream_deduplicate(spark, sf):
    source = f"{sf}/events*.parquet"
    stream = live.stream_table(spark, source, A.table(spark, sf, "events").schema)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = live.deduplicate(doubled, ["user_id", "event_id"], "ts")
    out = shared_dir(spark, "dedup")
    live.append_available(unique.select("user_id", "event_id", "ts"), out, shared_dir(spark, "dedup-state"))
    return spark.read.parquet(out).groupBy(
        (F.col("user_id") % 5).alias("session_key"), F.col("user_id").alias("driver_number")
    ).agg(F.count(F.lit(1)).alias("reports"), F.max("ts").alias("newest"))


@query("stream_latest_position", f"""WITH {POSITION}
SELECT session_key, driver_number, arg_max(position, date) AS position, max(date) AS date FROM pos GROUP BY 1, 2""")
def stream_latest_position(spark, sf):
    landing, out = shared_dir(spark, "position"), shared_dir(spark, "latest")
    A.position(spark, sf).repartition(3).write.parquet(landing)
    stream = live.stream_table(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
    live.run_available(stream, live.upsert_latest_position(out), shared_dir(spark, "latest-state"))
    return spark.read.parquet(out).withColumn("session_key", F.col("session_key").cast("long"))


@query("live_position_updates", ORACLES["stream_latest_position"])
def live_position_updates(spark, sf):
    """Latest positions kept as streaming state; each batch stores only the drivers it changes."""
    landing, out = shared_dir(spark, "position"), shared_dir(spark, "position-updates")
    A.position(spark, sf).repartition(3).write.parquet(landing)
    stream = live.stream_table(spark, landing, spark.read.parquet(landing).schema, files_per_batch=1)
    updates = live.latest_position_updates(stream)
    live.start_updates(updates, out, shared_dir(spark, "position-updates-state")).awaitTermination()
    return live.current_positions(spark, out)


QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("live_lap_quantiles", f"""WITH {LAPS}
SELECT session_key, quantile, count(*) AS n, true AS within_bound
FROM laps, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS quantile) GROUP BY 1, 2""")
def live_lap_quantiles(spark, sf):
    """Quantiles merged from the sketches of three batches: are their exact ranks within twice the stated error?"""
    laps = A.laps(spark, sf)
    landing, out = shared_dir(spark, "sketch-laps"), shared_dir(spark, "sketches")
    laps.repartition(3).write.parquet(landing)
    stream = live.stream_table(spark, landing, laps.schema, files_per_batch=1)
    live.run_available(stream, live.store_sketches(out, "lap_duration"), shared_dir(spark, "sketch-state"))
    found = live.live_quantiles(spark, out, QUARTILES)
    off = K.rank_deviation(laps, L.SESSION, "lap_duration", found, QUARTILES)
    return off.select("session_key", "quantile", "n", (F.col("deviation") <= 2 * K.rank_error()).alias("within_bound"))


@query("live_gap_to_leader", f"""WITH {CUMULATIVE}
SELECT session_key, driver_number, lap_number, round(cum_time, 6) AS cum_time, round(gap, 6) AS gap FROM gaps""")
def live_gap_to_leader(spark, sf):
    return _live(spark, sf, "gap_to_leader")


def _live(spark, sf, name):
    """One analytic over laps, stints and positions that arrive in several batches, by the engine's own schemas."""
    laps = A.laps(spark, sf)
    micros = F.unix_micros(F.col("date").cast("timestamp")) - F.round(F.col("lap_duration") * 1_000_000).cast("long")
    sources = {
        "laps": (live.stream_laps, laps.select(*L.LAP, "lap_duration", "is_pit_out_lap", F.lit(None).cast("int").alias("st_speed"),
                                               F.timestamp_micros(micros).alias("date_start")), LAP_SCHEMA),
        "stints": (live.stream_stints, A.stints(laps), STINT_SCHEMA),
        "position": (live.stream_position, A.position(spark, sf), POSITION_SCHEMA),
    }
    store, results = shared_dir(spark, "live-store"), shared_dir(spark, "live-results")
    for kind, (stream, rows, schema) in sources.items():
        landing = shared_dir(spark, f"landing-{kind}")
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).repartition(2).write.parquet(landing)
        apply = live.live_analytics(store, results, kind, {name: live.ANALYTICS[name]})
        live.run_available(stream(spark, landing, files_per_batch=1), apply, shared_dir(spark, f"state-{kind}"))
    return spark.read.parquet(f"{results}/{name}").withColumn("session_key", F.col("session_key").cast("long"))


@query("live_rolling_pace", f"""WITH {ROLLING}
SELECT session_key, driver_number, lap_number, round(rolling_pace, 6) AS rolling_pace FROM rolling""")
def live_rolling_pace(spark, sf):
    return _live(spark, sf, "rolling_pace")


@query("live_pace_summary", ORACLES["pace_summary"], digits=9)
def live_pace_summary(spark, sf):
    return _live(spark, sf, "pace_summary")


@query("live_stint_degradation", ORACLES["stint_degradation"], digits=10)
def live_stint_degradation(spark, sf):
    return _live(spark, sf, "stint_degradation")


@query("live_undercuts", ORACLES["detect_undercuts"])
def live_undercuts(spark, sf):
    return _live(spark, sf, "undercuts")


@query("live_projection", ORACLES["project_finish"])
def live_projection(spark, sf):
    return _live(spark, sf, "projection")


def _keyed(spark, sf):
    """Stores of lap and gap changes after two batches: wrong and missing laps first, then all others and the corrections."""
    laps = A.laps(spark, sf).select(*L.LAP, "lap_duration", "is_pit_out_lap", F.col("date").alias("date_start"))
    early = F.xxhash64(*L.LAP) % 2 == 0
    wrong = laps.where(early).withColumn("lap_duration", F.when(F.col("lap_number") % 7 == 0, F.col("lap_duration") + 100).otherwise(F.col("lap_duration")))
    rest = laps.where(~early | (F.col("lap_number") % 7 == 0))
    landing, changes, gaps, *states = (shared_dir(spark, n) for n in ("keyed-laps", "lap-changes", "gap-changes", "lap-state", "gap-state"))
    for batch in (wrong, rest):
        batch.withColumn("st_speed", F.lit(None).cast("int")).select(
            *[F.col(f.name).cast(f.dataType) for f in LAP_SCHEMA]).write.mode("append").parquet(landing)
        keyed.start_changes(keyed.lap_changes(live.stream_laps(spark, landing)), changes, states[0]).awaitTermination()
        changed = keyed.stream_changes(spark, changes, keyed.LAP_CHANGES)
        keyed.start_changes(keyed.gap_changes(changed), gaps, states[1]).awaitTermination()
    return changes, gaps


@query("keyed_gap_to_leader", f"""WITH {CUMULATIVE}
SELECT session_key, driver_number, lap_number, round(cum_time, 6) AS cum_time, round(gap, 6) AS gap FROM gaps""")
def keyed_gap_to_leader(spark, sf):
    """Running time and gap from state per driver and lap, after laps that came out of order and were corrected."""
    return keyed.current(spark, _keyed(spark, sf)[1])


@query("keyed_rolling_pace", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, CASE WHEN count(*) OVER w >= 5 THEN round(avg(lap_duration) OVER w, 6) END AS rolling_pace
FROM laps WHERE lap_duration IS NOT NULL
WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def keyed_rolling_pace(spark, sf):
    """Rolling pace over full windows from state per driver."""
    return keyed.current(spark, _keyed(spark, sf)[0]).select(*L.LAP, "rolling_pace")


@query("live_fastest_lap_samples", f"""WITH {FASTEST}
SELECT session_key, driver_number, date, round(speed, 6) AS speed, lap_number, lap_time FROM fast""")
def live_fastest_lap_samples(spark, sf):
    """Samples joined with their laps as both arrive as streams, in files of their own; then those of the fastest laps."""
    landing = {kind: shared_dir(spark, f"landing-{kind}") for kind in ("car", "car-laps")}
    with scratch_tables(spark):
        car = materialize(A.car_data(spark, sf))
        laps = A.car_laps(car).withColumn("st_speed", F.lit(None).cast("int"))
        for kind, rows, schema in (("car", car, CAR_SCHEMA), ("car-laps", laps, LAP_SCHEMA)):
            with shuffles_removed(spark):
                rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).repartition(2).write.parquet(landing[kind])
    stream = live.lap_samples(
        live.stream_laps(spark, landing["car-laps"], files_per_batch=1), live.stream_car_data(spark, landing["car"], files_per_batch=1),
        longest="365 days", delay="3650 days")
    # State holds a sample as wide as it goes out.
    stream = stream.select(*L.LAP, "date", "speed", "lap_time")
    out, state = shared_dir(spark, "lap-samples"), shared_dir(spark, "lap-samples-state")
    with shuffles_removed(spark):
        live.append_available(stream, out, state)
    remove_folder(spark, state)
    remove_folder(spark, landing["car"])
    found = live.fastest_lap_samples(spark.read.parquet(out), spark.read.schema(LAP_SCHEMA).parquet(landing["car-laps"]))
    return found.select("session_key", "driver_number", "date", "speed", "lap_number", "lap_time")


@query("latest_session", """WITH l AS (SELECT user_id % 5 AS session_key, user_id AS driver_number, count(*) AS laps FROM events GROUP BY 1, 2)
SELECT * FROM l WHERE session_key = (SELECT max(session_key) FROM l)""")
def latest_session(spark, sf):
    newest = live.latest_session(A.laps(spark, sf))
    return newest.groupBy(*L.DRIVER).agg(F.count(F.lit(1)).alias("laps"))


# --- source scans: race tables landed as files, read back with their schemas ---


def _landed(spark, df, name, fmt="parquet"):
    path = shared_dir(spark, name)
    df.write.partitionBy("session_key").format(fmt).save(path)
    return path


@query("read_laps", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, CAST(NULL AS BIGINT) AS st_speed,
       CAST(NULL AS TIMESTAMP) AS date_start, CAST(NULL AS TIMESTAMP) AS date FROM laps""")
def read_laps(spark, sf):
    """JSON laps: fields the files do not have read as null."""
    rows = A.laps(spark, sf).select(*L.LAP, "lap_duration", "is_pit_out_lap")
    return tables.read_laps(spark, _landed(spark, rows, "laps-json", "json"), "json")


@query("read_laps_with_nan", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, CASE WHEN lap_number % 7 <> 0 THEN lap_duration END AS lap_duration,
       CASE WHEN lap_number % 7 <> 0 THEN date + to_microseconds(CAST(round(lap_duration * 1000000) AS BIGINT)) END AS date
FROM laps""")
def read_laps_with_nan(spark, sf):
    """NaN durations read as null; the lap's end comes from its start."""
    nan = F.when(F.col("lap_number") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("lap_duration"))
    rows = A.laps(spark, sf).select(*L.LAP, nan.alias("lap_duration"), F.col("date").alias("date_start"))
    return tables.read_laps(spark, _landed(spark, rows, "laps-nan")).select(*L.LAP, "lap_duration", "date")


@query("read_stints", f"""WITH {LAPS}, {STINTS}
SELECT session_key, driver_number, stint_number, compound, tyre_age_at_start, lap_start, lap_end FROM stints""")
def read_stints(spark, sf):
    return tables.read_stints(spark, _landed(spark, A.stints(A.laps(spark, sf)), "stints"))


@query("read_position", f"""WITH {POSITION} SELECT session_key, driver_number, position, date FROM pos""")
def read_position(spark, sf):
    return tables.read_position(spark, _landed(spark, A.position(spark, sf), "position"))


@query("read_drivers", """SELECT c_custkey % 5 AS session_key, c_custkey AS driver_number,
       CASE WHEN c_acctbal >= 0 THEN upper(substr(c_mktsegment, 1, 3)) END AS name_acronym, c_name AS full_name,
       'TEAM ' || c_nationkey AS team_name, 'ff00' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS team_colour
FROM customer""")
def read_drivers(spark, sf):
    return tables.read_drivers(spark, _landed(spark, A.drivers(spark, sf), "drivers"))


# --- lines with faults: rows whose lap number is divisible by 11, 13 or 17 ---

FAULTS = f"""{LAPS},
told AS (
  SELECT *, CASE WHEN lap_number % 11 = 0 THEN 'bad line' WHEN lap_number % 13 = 0 THEN 'missing driver_number'
                 WHEN lap_number % 17 = 0 THEN 'bad time date_start' END AS reason FROM laps)"""


def _quarantined(spark, sf):
    """Laps landed as JSON lines, some cut short, some without a driver, some with a time that is none; then ingested."""
    laps = A.laps(spark, sf)

    def faulty(n):
        return F.col("lap_number") % n == 0

    fields = F.struct(
        "session_key", F.when(~faulty(13), F.col("driver_number")).alias("driver_number"), "lap_number", "lap_duration",
        "is_pit_out_lap", F.when(faulty(17), "soon").otherwise(F.col("date").cast("string")).alias("date_start"))
    line = F.to_json(fields)
    cut = F.when(faulty(11), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    landing, out = shared_dir(spark, "lines"), shared_dir(spark, "checked")
    laps.select(cut.alias("value")).write.text(landing)
    quarantine.ingest_checked(spark, landing, out, LAP_SCHEMA, L.LAP)
    return out


@query("ingest_good", f"""WITH {FAULTS}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date AS date_start FROM told WHERE reason IS NULL""")
def ingest_good(spark, sf):
    """The rows that passed."""
    rows = quarantine.good_rows(spark, _quarantined(spark, sf), LAP_SCHEMA)
    return rows.select(*L.LAP, "lap_duration", "is_pit_out_lap", "date_start")


@query("ingest_rejects", f"""WITH {FAULTS}
SELECT reason, CASE WHEN reason = 'bad line' THEN 'unknown' ELSE CAST(session_key AS VARCHAR) END AS session, count(*) AS rejects
FROM told WHERE reason IS NOT NULL GROUP BY 1, 2""")
def ingest_rejects(spark, sf):
    """Rejected lines by reason and, where it could be read, session."""
    rows = quarantine.rejected_lines(spark, _quarantined(spark, sf), LAP_SCHEMA)
    session = F.coalesce(F.col("session_key").cast("string"), F.lit("unknown"))
    return rows.groupBy("reason", session.alias("session")).agg(F.count(F.lit(1)).alias("rejects"))
