"""Telemetry queries over samples and car data derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapspark.functions.scalar import upsample
from lapspark.operators import compare as C
from lapspark.operators import ml as M
from lapspark.operators import profiles as R
from lapspark.operators import telemetry as T
from lapspark.operators.laps import DRIVER, LAP
from lapspark.operators.quality import training_rows
from lapspark.plans.registry import query
from lapspark.schemas import MODEL_FEATURES, STYLE_FEATURES, STYLE_PROFILES
from lapspark.session import materialize
from lapspark.sources import adapters as A
from lapspark.sources import tables

CH = ["speed", "throttle", "brake", "n_gear", "x", "y", "steer"]
KEYS = "session_key, driver_number, lap_number"
SAMPLES = """samples AS (
  SELECT l_suppkey % 5 AS session_key, l_suppkey AS driver_number, l_partkey % 5 + 1 AS lap_number,
         row_number() OVER w AS sample_no, sum(l_quantity) OVER w AS distance,
         l_extendedprice / 300 AS speed, l_discount * 1000 AS throttle, l_tax * 100 AS brake,
         CAST(l_linenumber AS DOUBLE) AS n_gear, l_quantity * 200 AS rpm, l_extendedprice / 100 AS x,
         l_orderkey / 10 AS y, l_discount - l_tax AS steer
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey, l_partkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sample_laps AS (
  SELECT l_suppkey % 5 AS session_key, l_suppkey AS driver_number, l_partkey % 5 + 1 AS lap_number,
         sum(l_quantity) % 60 + 60 AS lap_time_seconds FROM lineitem GROUP BY 1, 2, 3)"""


def grid_sql(source: str, keys: str, order: str, axis: str, channels: list[str], points: int, name: str) -> str:
    """Resampling in SQL: every sample with the grid points around its segment, then those inside it."""
    leads = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in channels)
    values = ", ".join(
        f"CASE WHEN x1 IS NULL THEN {c} ELSE (n_{c} - {c}) / (x1 - {axis}) * (g - {axis}) + {c} END AS {c}"
        for c in channels
    )
    cols = ", ".join(channels)
    last = points - 1
    return f"""{name}_seg AS (
  SELECT {keys}, {axis}, {cols}, lead({axis}) OVER w AS x1, {leads},
         first_value({axis}) OVER full_w AS d0, last_value({axis}) OVER full_w AS d1,
         count(*) OVER (PARTITION BY {keys}) AS n
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY {order}),
         full_w AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_pts AS (
  SELECT *, CASE WHEN k = {last} THEN d1 ELSE k * ((d1 - d0) / {last}.0) + d0 END AS g
  FROM (SELECT *, unnest(range(
          CASE WHEN d1 > d0 THEN greatest(0, floor(({axis} - d0) / (d1 - d0) * {last}) - 1)::BIGINT ELSE 0 END,
          CASE WHEN d1 > d0 AND x1 IS NOT NULL
               THEN least({points}, floor((x1 - d0) / (d1 - d0) * {last}) + 2)::BIGINT ELSE {points} END)) AS k
        FROM {name}_seg)),
{name} AS (
  SELECT {keys}, k, g, n, {values} FROM {name}_pts
  WHERE g >= {axis} AND (x1 IS NULL OR g < x1))"""


GRID = f"{SAMPLES}, {grid_sql('samples', KEYS, 'sample_no', 'distance', CH, 200, 'grid')}"
FEATURES = f"""{GRID},
marked AS (
  SELECT *, lag(brake > 0) OVER w AS was_on, lag(round_even(n_gear, 0)) OVER w AS old_gear
  FROM grid WHERE n >= 10 WINDOW w AS (PARTITION BY {KEYS} ORDER BY k)),
features AS (
  SELECT {KEYS}, avg(speed) AS mean_speed, max(speed) AS max_speed, min(speed) AS min_speed,
         avg(throttle) AS throttle_mean, stddev_pop(throttle) AS throttle_std, avg(brake) AS brake_mean,
         count(*) FILTER (WHERE brake > 0 AND NOT was_on) AS brake_events,
         count(*) FILTER (WHERE k > 0 AND round_even(n_gear, 0) <> old_gear) AS gear_changes,
         stddev_pop(steer) AS steer_std,
         avg(CASE WHEN throttle < 2 AND brake < 1 THEN 1.0 ELSE 0.0 END) AS coasting_pct,
         avg(CASE WHEN throttle > 80 THEN 1.0 ELSE 0.0 END) AS throttle_pickup_pct,
         avg(CASE WHEN throttle > 0 AND brake > 0 THEN 1.0 ELSE 0.0 END) AS trail_brake_score
  FROM marked GROUP BY ALL),
timed AS (SELECT f.*, l.lap_time_seconds FROM features f JOIN sample_laps l USING ({KEYS}))"""
SCALARS = [
    "mean_speed", "max_speed", "min_speed", "throttle_mean", "throttle_std", "brake_mean",
    "brake_events", "gear_changes", "steer_std",
]


def rounded(columns: list[str], digits: int = 6, fn: str = "{}") -> str:
    return ", ".join(f"round({fn.format(c)}, {digits}) AS {c}" for c in columns)


def counts_as_is(columns: list[str], digits: int = 6) -> str:
    return ", ".join(
        c if c in ("brake_events", "gear_changes") else f"round({c}, {digits}) AS {c}" for c in columns
    )


@query("resample", f"""WITH {GRID}
SELECT {KEYS}, k, round(g, 6) AS grid, {rounded(CH)} FROM grid""")
def resample(spark, sf):
    return T.resample(A.samples(spark, sf), LAP, "sample_no", "distance", CH)


@query("axis_violations", f"""WITH {SAMPLES},
steps AS (SELECT {KEYS}, rpm < lag(rpm) OVER (PARTITION BY {KEYS} ORDER BY sample_no) AS down FROM samples)
SELECT {KEYS}, count(*) AS decreasing_steps FROM steps WHERE down GROUP BY ALL""")
def axis_violations(spark, sf):
    return T.axis_violations(A.samples(spark, sf), LAP, "sample_no", "rpm")


@query("lap_features", f"""WITH {FEATURES} SELECT {KEYS}, {counts_as_is(SCALARS)} FROM features""")
def lap_features(spark, sf):
    return T.lap_features(A.samples(spark, sf)).select(*LAP, *SCALARS)


@query("timed_lap_features", f"""WITH {FEATURES}
SELECT {KEYS}, lap_time_seconds, {counts_as_is(SCALARS)} FROM (
  SELECT t.*, (SELECT min(lap_time_seconds) FROM sample_laps s WHERE s.driver_number = t.driver_number) AS best
  FROM timed t) WHERE lap_time_seconds <= best * 1.2""")
def timed_lap_features(spark, sf):
    rows = T.timed_lap_features(A.samples(spark, sf), A.sample_laps(spark, sf), 1.2)
    return rows.select(*LAP, "lap_time_seconds", *SCALARS)


@query("extended_features", f"""WITH {FEATURES}
SELECT {KEYS}, {rounded(['coasting_pct', 'throttle_pickup_pct', 'trail_brake_score'])} FROM features""")
def extended_features(spark, sf):
    rows = T.extended_features(T.lap_features(A.samples(spark, sf)))
    return rows.select(*LAP, "coasting_pct", "throttle_pickup_pct", "trail_brake_score")


@query("mean_trace", f"""WITH {GRID}
SELECT session_key, driver_number, k, round(avg(speed), 6) AS speed_trace FROM grid WHERE n >= 10 GROUP BY ALL""")
def mean_trace(spark, sf):
    return T.mean_trace(T.lap_features(A.samples(spark, sf)), DRIVER, ["speed_trace"])


@query("zone_means", f"""WITH {GRID}
SELECT session_key, driver_number, CAST(CASE WHEN k < 67 THEN 1 WHEN k < 134 THEN 2 ELSE 3 END AS BIGINT) AS zone,
       round(avg(speed), 6) AS zone_mean FROM grid WHERE n >= 10 GROUP BY ALL""")
def zone_means(spark, sf):
    return T.zone_means(T.lap_features(A.samples(spark, sf)), DRIVER, "speed_trace")


@query("throttle_map", f"""WITH {GRID}
SELECT session_key, driver_number, k, round(avg(x), 6) AS x_trace, round(avg(y), 6) AS y_trace,
       round(avg(throttle), 6) AS throttle_trace FROM grid WHERE n >= 10 GROUP BY ALL""")
def throttle_map(spark, sf):
    return T.throttle_map(T.lap_features(A.samples(spark, sf)), DRIVER)


REPRESENTATIVE = f"""busiest AS (
  SELECT session_key, driver_number FROM (
    SELECT session_key, driver_number, row_number() OVER (
      PARTITION BY session_key ORDER BY count(*) DESC, driver_number) AS rn
    FROM sample_laps GROUP BY 1, 2) WHERE rn = 1),
representative AS (
  SELECT {KEYS} FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY lap_time_seconds, lap_number) AS rn
    FROM sample_laps SEMI JOIN busiest USING (session_key, driver_number)) WHERE rn = 1)"""


@query("representative_lap", f"""WITH {SAMPLES}, {REPRESENTATIVE} SELECT * FROM representative""")
def representative_lap(spark, sf):
    return T.representative_lap(A.sample_laps(spark, sf), 1.07)


@query("circuit_outline", f"""WITH {SAMPLES}, {REPRESENTATIVE},
theirs AS (SELECT s.* FROM samples s SEMI JOIN representative r USING ({KEYS})),
{grid_sql('theirs', KEYS, 'sample_no', 'distance', ['x', 'y'], 500, 'outline')}
SELECT {KEYS}, k, round(g, 6) AS grid, round(x, 6) AS x, round(y, 6) AS y FROM outline""")
def circuit_outline(spark, sf):
    return T.circuit_outline(A.samples(spark, sf), A.sample_laps(spark, sf), 1.07)


CAR = """car AS (
  SELECT l_suppkey % 5 AS session_key, l_suppkey AS driver_number,
         TIMESTAMP '2024-01-01' + to_microseconds(l_orderkey * 1000000 + l_linenumber * 100000) AS date,
         max(l_extendedprice) / 300 AS speed, max(l_discount) * 1000 AS throttle, max(l_tax) * 100 AS brake,
         CAST(max(l_linenumber) AS BIGINT) AS n_gear, max(l_quantity) * 200 AS rpm
  FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
car_laps AS (
  SELECT session_key, driver_number,
         CAST(floor((epoch_us(date) - 1704067200000000) / 5000000000) AS BIGINT) + 1 AS lap_number,
         (epoch_us(max(date)) - epoch_us(min(date))) / 1000000.0 AS lap_duration, min(date) AS date_start
  FROM car GROUP BY 1, 2, 3)"""
FASTEST = f"""{CAR},
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number
                                              ORDER BY lap_duration, lap_number) AS rn FROM car_laps) WHERE rn = 1),
fast AS (
  SELECT c.*, b.lap_number, b.lap_duration AS lap_time
  FROM car c JOIN best b ON c.session_key = b.session_key AND c.driver_number = b.driver_number
   AND epoch_us(c.date) BETWEEN epoch_us(b.date_start)
       AND epoch_us(b.date_start) + CAST(round((b.lap_duration + 0.5) * 1000000) AS BIGINT))"""
PROXY = f"""{FASTEST},
stepped AS (
  SELECT *, coalesce(lag(speed) OVER w / 3.6 * ((epoch_us(date) - epoch_us(lag(date) OVER w)) / 1000000.0), 0) AS step,
         (epoch_us(date) - epoch_us(first_value(date) OVER w)) / 1000000.0 AS elapsed,
         row_number() OVER w AS i, count(*) OVER (PARTITION BY session_key, driver_number) AS n_rows
  FROM fast WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY date)),
proxy AS (
  SELECT *, sum(step) OVER (PARTITION BY session_key, driver_number ORDER BY date
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS distance FROM stepped)"""
TRACES = f"""{PROXY},
{grid_sql('proxy', 'session_key, driver_number', 'date', 'distance', ['speed', 'throttle', 'brake'], 200, 'bydist')},
{grid_sql('(SELECT *, CAST(i AS DOUBLE) AS ix FROM proxy)', 'session_key, driver_number', 'i', 'ix', ['elapsed'], 200, 'byindex')},
traces AS MATERIALIZED (
  SELECT d.session_key, d.driver_number, d.k, d.speed, d.throttle, d.brake, i.elapsed AS cumtime
  FROM bydist d JOIN byindex i USING (session_key, driver_number, k) WHERE d.n >= 2)"""


@query("car_data_range", f"""WITH {CAR}
SELECT session_key, driver_number, date, round(speed, 6) AS speed, round(throttle, 6) AS throttle, round(brake, 6) AS brake,
       n_gear, round(rpm, 6) AS rpm FROM car
WHERE driver_number = 7 AND date BETWEEN TIMESTAMP '2024-01-01 00:05:00' AND TIMESTAMP '2024-01-01 01:00:00'""")
def car_data_range(spark, sf):
    return tables.car_data_between(A.car_data(spark, sf), 7, "2024-01-01 00:05:00", "2024-01-01 01:00:00")


@query("distance_proxy", f"""WITH {PROXY}
SELECT session_key, driver_number, date, round(distance, 6) AS distance, round(elapsed, 6) AS elapsed FROM proxy""")
def distance_proxy(spark, sf):
    car = materialize(A.car_data(spark, sf))
    rows = T.distance_proxy(materialize(T.fastest_lap_samples(A.car_laps(car), car)))
    return rows.select(*DRIVER, "date", "distance", "elapsed")


@query("fastest_lap_samples", f"""WITH {FASTEST}
SELECT session_key, driver_number, date, round(speed, 6) AS speed, lap_number, lap_time FROM fast""")
def fastest_lap_samples(spark, sf):
    car = materialize(A.car_data(spark, sf))
    return T.fastest_lap_samples(A.car_laps(car), car).select(*DRIVER, "date", "speed", "lap_number", "lap_time")


def _traces(spark, sf):
    car = materialize(A.car_data(spark, sf))
    return T.fastest_lap_traces(A.car_laps(car), car)


@query("fastest_lap_traces", f"""WITH {TRACES}
SELECT session_key, driver_number, k, round(speed, 6) AS speed, round(throttle, 6) AS throttle,
       round(brake, 6) AS brake, round(cumtime, 6) AS cumtime FROM traces""")
def fastest_lap_traces(spark, sf):
    both = F.arrays_zip(
        F.col("speed_trace").alias("speed"), F.col("throttle_trace").alias("throttle"),
        F.col("brake_trace").alias("brake"), F.col("cumtime").alias("cumtime"),
    )
    return _traces(spark, sf).select(*DRIVER, F.posexplode(both).alias("k", "p")).select(*DRIVER, "k", "p.*")


def _pairs(traces):
    """Each driver against the next number of the same session."""
    return traces.select(
        "session_key", F.col("driver_number").alias("driver_a"), (F.col("driver_number") + 5).alias("driver_b")
    )


def _lap_pairs(spark, sf):
    traces = materialize(_traces(spark, sf))
    return C.lap_pairs(traces, _pairs(traces))


DELTA = f"""{TRACES},
delta AS (
  SELECT a.session_key, a.driver_number AS driver_a, b.driver_number AS driver_b, a.k,
         b.cumtime - a.cumtime AS delta
  FROM traces a JOIN traces b ON a.session_key = b.session_key AND b.driver_number = a.driver_number + 5
   AND a.k = b.k),
changes AS (
  SELECT *, coalesce(sign(lead(delta) OVER (PARTITION BY session_key, driver_a, driver_b ORDER BY k))
                     <> sign(delta), false) AS lead_change FROM delta)"""


@query("time_delta", f"""WITH {DELTA}
SELECT session_key, driver_a, driver_b, k, round(k * 100.0 / 199, 6) AS lap_pct, round(delta, 6) AS delta,
       round(CASE WHEN delta >= 0 THEN delta ELSE 0 END, 6) AS ahead_a,
       round(CASE WHEN delta < 0 THEN delta ELSE 0 END, 6) AS ahead_b, lead_change FROM changes""")
def time_delta(spark, sf):
    return C.time_delta(_lap_pairs(spark, sf))


@query("time_delta_summary", f"""WITH {DELTA},
s AS (SELECT session_key, driver_a, driver_b, count(*) FILTER (WHERE lead_change) AS lead_changes,
             max(delta) AS hi, min(delta) AS lo, arg_max(delta, k) AS final_gap FROM changes GROUP BY ALL)
SELECT session_key, driver_a, driver_b, lead_changes, round(CASE WHEN hi > 0.05 THEN hi END, 6) AS peak_a,
       CASE WHEN hi > 0.05 THEN (SELECT min(k) FROM changes c WHERE c.driver_a = s.driver_a AND c.delta = s.hi) END AS peak_a_k,
       round(CASE WHEN lo < -0.05 THEN lo END, 6) AS peak_b,
       CASE WHEN lo < -0.05 THEN (SELECT min(k) FROM changes c WHERE c.driver_a = s.driver_a AND c.delta = s.lo) END AS peak_b_k,
       round(final_gap, 6) AS final_gap,
       CASE WHEN abs(final_gap) < 0.001 THEN 'dead heat' WHEN final_gap > 0 THEN 'a' ELSE 'b' END AS ahead_at_finish
FROM s""")
def time_delta_summary(spark, sf):
    return C.time_delta_summary(C.time_delta(_lap_pairs(spark, sf)))


SECTORS = f"""{TRACES},
wide AS (SELECT session_key, driver_number, list(speed ORDER BY k) AS v FROM traces GROUP BY 1, 2),
fine AS MATERIALIZED (
  SELECT session_key, driver_number, k,
         (v[least(CAST(floor(k * (199 / 999.0)) AS BIGINT) + 2, 200)] - v[least(CAST(floor(k * (199 / 999.0)) AS BIGINT), 199) + 1])
           * (k * (199 / 999.0) - least(floor(k * (199 / 999.0)), 199)) + v[least(CAST(floor(k * (199 / 999.0)) AS BIGINT), 199) + 1] AS speed
  FROM wide, range(0, 1000) r(k)),
sectors AS (
  SELECT a.session_key, a.driver_number AS driver_a, b.driver_number AS driver_b, a.k,
         CASE WHEN a.speed >= b.speed THEN 'a' ELSE 'b' END AS winner
  FROM fine a JOIN fine b ON a.session_key = b.session_key AND b.driver_number = a.driver_number + 5 AND a.k = b.k
  WHERE a.k < 999)"""


@query("upsample", f"""WITH {SECTORS}
SELECT session_key, driver_number, k, round(speed, 5) AS speed FROM fine""", digits=5)
def upsampled(spark, sf):
    fine = upsample(F.col("speed_trace"), 1000)
    return _traces(spark, sf).select(*DRIVER, F.posexplode(fine).alias("k", "speed"))


@query("microsectors", f"""WITH {SECTORS} SELECT * FROM sectors""")
def microsectors(spark, sf):
    return C.microsectors(_lap_pairs(spark, sf))


@query("microsector_runs", f"""WITH {SECTORS},
m AS (SELECT *, CASE WHEN lag(winner) OVER w <> winner THEN 1 ELSE 0 END AS new FROM sectors
      WINDOW w AS (PARTITION BY session_key, driver_a, driver_b ORDER BY k)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_key, driver_a, driver_b ORDER BY k
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM m)
SELECT session_key, driver_a, driver_b, run, any_value(winner) AS winner, min(k) AS first_point,
       max(k) + 1 AS last_point FROM r GROUP BY 1, 2, 3, 4""")
def microsector_runs(spark, sf):
    return C.microsector_runs(_lap_pairs(spark, sf))


# --- driver profiles over the lap features ---

STYLE_SQL = ", ".join(f"avg({f}) AS {f}" for f in STYLE_FEATURES)
BASE = ["mean_speed", "throttle_mean", "throttle_std", "brake_events", "steer_std", "gear_changes"]
NORMALISED = f"""{FEATURES},
bounds AS (SELECT session_key, {', '.join(f'min({f}) AS lo_{f}, max({f}) AS hi_{f}' for f in STYLE_FEATURES)}
           FROM features GROUP BY 1),
normalised AS (
  SELECT f.session_key, driver_number,
         {', '.join(f'avg(({f} - lo_{f}) / CASE WHEN hi_{f} = lo_{f} THEN 1.0 ELSE hi_{f} - lo_{f} END) AS {f}' for f in STYLE_FEATURES)}
  FROM features f JOIN bounds b ON f.session_key = b.session_key GROUP BY 1, 2)"""


def _features(spark, sf):
    return T.extended_features(T.lap_features(A.samples(spark, sf)))


@query("driver_profile", f"""WITH {FEATURES}
SELECT session_key, driver_number, {rounded(STYLE_FEATURES, 6, 'avg({})')},
       {', '.join(f'round(stddev_pop({f}), 6) AS {f}_std' for f in BASE)}
FROM features GROUP BY 1, 2""")
def driver_profile(spark, sf):
    return R.driver_profile(_features(spark, sf))


@query("normalised_profile", f"""WITH {NORMALISED}
SELECT session_key, driver_number, {rounded(STYLE_FEATURES)} FROM normalised""")
def normalised_profile(spark, sf):
    return R.normalised_profile(materialize(_features(spark, sf).select(*LAP, *STYLE_FEATURES)))


@query("consistency_matrix", f"""WITH {FEATURES},
spread AS (SELECT session_key, driver_number, {', '.join(f'stddev_pop({f}) AS {f}' for f in BASE)}
           FROM features GROUP BY 1, 2)
SELECT session_key, driver_number,
       {', '.join(f'round(({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w + 1e-9), 6) AS {f}' for f in BASE)}
FROM spread WINDOW w AS (PARTITION BY session_key)""")
def consistency_matrix(spark, sf):
    return R.consistency_matrix(materialize(_features(spark, sf).select(*LAP, *BASE)))


@query("archetype", f"""WITH {NORMALISED}
SELECT session_key, driver_number,
  CASE WHEN brake_events > 0.65 AND brake_mean > 0.60 THEN 'Aggressive Braker'
       WHEN trail_brake_score > 0.55 AND steer_std > 0.60 THEN 'Trail Braking Specialist'
       WHEN mean_speed > 0.70 AND coasting_pct < 0.35 THEN 'High Entry Speed'
       WHEN throttle_pickup_pct > 0.60 AND throttle_std < 0.40 THEN 'Smooth Operator'
       WHEN gear_changes > 0.65 AND steer_std > 0.55 THEN 'Technical Driver'
       ELSE 'Balanced Driver' END AS archetype FROM normalised""")
def archetype(spark, sf):
    laps = materialize(_features(spark, sf).select(*LAP, *STYLE_FEATURES))
    return R.archetype(R.normalised_profile(laps)).select(*DRIVER, "archetype")


STYLE_VALUES = ", ".join(f"('{name}', '{era}', {vector})" for name, era, vector in STYLE_PROFILES)


@query("style_matches", f"""WITH {NORMALISED},
styles(name, era, vector) AS (VALUES {STYLE_VALUES}),
asked AS (SELECT session_key || '/' || driver_number AS query_id,
                 CAST([{', '.join(STYLE_FEATURES)}] AS DOUBLE[]) AS v FROM normalised),
scored AS (
  SELECT query_id, name, era, CASE WHEN list_inner_product(v, v) < 1e-18 THEN 0.0
         ELSE list_cosine_similarity(v, CAST(vector AS DOUBLE[])) END AS similarity FROM asked, styles)
SELECT query_id, rank, name, era, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, name) AS rank FROM scored)
WHERE rank <= 2""")
def style_matches(spark, sf):
    """Nearest built-in style profiles of every driver's normalised profile."""
    laps = materialize(_features(spark, sf).select(*LAP, *STYLE_FEATURES))
    asked = R.normalised_profile(laps).select(
        F.concat_ws("/", *DRIVER).alias("query_id"), F.array(*STYLE_FEATURES).alias("vector")
    )
    return R.cosine_topk(asked, R.style_profiles(spark), 2)


TRAINING = f"""{FEATURES},
training AS (
  SELECT {KEYS}, CAST(driver_number AS VARCHAR) AS label, session_key || '/' || driver_number || '/' || lap_number AS id,
         {', '.join(f'coalesce({f}, 0.0) AS {f}' if f == 'steer_std' else f for f in MODEL_FEATURES)}
  FROM timed WHERE {' AND '.join(f'{f} IS NOT NULL' for f in MODEL_FEATURES if f != 'steer_std')})"""


def training_table_rows(spark, sf):
    """Complete lap features with the driver as class: what the classifier is trained on."""
    laps = T.lap_features(A.samples(spark, sf)).join(A.sample_laps(spark, sf), LAP)
    return training_rows(laps).select(
        *LAP, F.col("driver_number").cast("string").alias("label"), F.concat_ws("/", *LAP).alias("id"), *MODEL_FEATURES)


@query("training_table", f"""WITH {TRAINING}
SELECT {KEYS}, label, {rounded(MODEL_FEATURES)} FROM training""")
def training_table(spark, sf):
    return training_table_rows(spark, sf).drop("id")


@query("training_folds", f"""WITH {TRAINING}, n AS (SELECT label, count(*) AS n FROM training GROUP BY 1)
SELECT label, f.fold, CAST((n - f.fold + 4) // 5 AS BIGINT) AS rows FROM n, range(0, 5) f(fold) WHERE (n - f.fold + 4) // 5 > 0""")
def training_folds(spark, sf):
    folds = M.stratified_folds(training_table_rows(spark, sf))
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("percentile_rank", f"""WITH {FEATURES},
long AS (SELECT session_key, driver_number, lap_number, f.feature, f.value FROM timed,
  LATERAL (VALUES {', '.join(f"('{f}', CAST({f} AS DOUBLE))" for f in MODEL_FEATURES)}) f(feature, value))
SELECT session_key, driver_number, lap_number, feature, round(value, 6) AS value,
       round(100.0 * cume_dist() OVER (PARTITION BY session_key, feature ORDER BY value), 6) AS percentile
FROM long""")
def percentile_rank(spark, sf):
    laps = T.lap_features(A.samples(spark, sf)).join(A.sample_laps(spark, sf), LAP)
    # The ranks and the laps must see the very same feature values, so they are written once.
    return R.percentile_rank(materialize(laps.select(*LAP, *MODEL_FEATURES)), MODEL_FEATURES, LAP[1:])


@query("feature_store", f"""WITH {FEATURES}
SELECT {KEYS}, {rounded([f for f in MODEL_FEATURES if f != 'lap_time_seconds'])} FROM features""")
def feature_store(spark, sf):
    """Written partitioned by session, read back through the pruned scan."""
    from lapspark.session import shared_dir

    path = shared_dir(spark, "features")
    tables.write_lap_features(T.lap_features(A.samples(spark, sf)), path)
    stored = tables.read_lap_features(spark, path)
    features = [f for f in MODEL_FEATURES if f != "lap_time_seconds"]
    return stored.select(*[F.col(c).cast("long").alias(c) for c in LAP], *features)
