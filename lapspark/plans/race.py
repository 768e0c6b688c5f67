"""Race-analysis queries over laps, stints and positions derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapspark.operators import laps as L
from lapspark.operators import positions as P
from lapspark.operators import stints as S
from lapspark.operators import strategy as X
from lapspark.operators.quantiles import grouped_median
from lapspark.plans.registry import query
from lapspark.sources import adapters as A
from lapspark.sources import tables

LAPS = """laps AS (
  SELECT user_id % 5 AS session_key, user_id AS driver_number,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lap_number,
         value AS lap_duration, event_type = 'signup' AS is_pit_out_lap, ts AS date
  FROM events)"""
VALID = """valid AS (SELECT * FROM laps WHERE lap_duration > 0 AND is_pit_out_lap IS DISTINCT FROM true)"""
CLEAN = f"""{LAPS}, {VALID},
clean AS (
  SELECT v.* FROM valid v
  JOIN (SELECT session_key, median(lap_duration) AS m FROM valid GROUP BY 1) s USING (session_key)
  WHERE v.lap_duration <= s.m * 1.10)"""
ROLLING = f"""{CLEAN},
rolling AS (
  SELECT *, avg(lap_duration) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_pace
  FROM clean)"""
STINTS = """stints AS (
  SELECT session_key, driver_number, CAST(floor((lap_number - 1) / 12) + 1 AS BIGINT) AS stint_number,
         CASE WHEN CAST(floor((min(lap_number) - 1) / 12) + 1 AS BIGINT) % 3 = 1 THEN 'SOFT'
              WHEN CAST(floor((min(lap_number) - 1) / 12) + 1 AS BIGINT) % 3 = 2 THEN 'MEDIUM'
              ELSE 'HARD' END AS compound,
         driver_number % 4 AS tyre_age_at_start,
         min(lap_number) AS lap_start, max(lap_number) AS lap_end
  FROM laps GROUP BY 1, 2, 3)"""
POSITION = """pos AS (
  SELECT user_id % 5 AS session_key, user_id AS driver_number, event_id % 20 + 1 AS position,
         ts + INTERVAL 1 SECOND AS date FROM events)"""
DRIVERS = """drivers AS (
  SELECT c_custkey % 5 AS session_key, c_custkey AS driver_number,
         CASE WHEN c_acctbal >= 0 THEN upper(substr(c_mktsegment, 1, 3)) END AS name_acronym,
         'FF00' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS colour FROM customer)"""
GRID = f"""{POSITION},
matched AS (
  SELECT p.session_key, p.driver_number, p.date, p.position, l.lap_number
  FROM pos p ASOF JOIN laps l
    ON p.session_key = l.session_key AND p.driver_number = l.driver_number AND p.date >= l.date),
recorded AS (
  SELECT session_key, driver_number, lap_number, position FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key, driver_number, lap_number
                                 ORDER BY date DESC, position DESC) AS rn FROM matched) WHERE rn = 1),
grid AS (
  SELECT d.session_key, d.driver_number, l.lap_number,
         last_value(r.position IGNORE NULLS) OVER (
           PARTITION BY d.session_key, d.driver_number ORDER BY l.lap_number
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position
  FROM (SELECT DISTINCT session_key, driver_number FROM recorded) d
  JOIN (SELECT DISTINCT session_key, lap_number FROM laps) l USING (session_key)
  LEFT JOIN recorded r USING (session_key, driver_number, lap_number))"""
CUMULATIVE = f"""{LAPS},
cum AS (
  SELECT session_key, driver_number, lap_number, lap_duration,
         sum(lap_duration) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_time
  FROM laps WHERE lap_duration > 0),
gaps AS (
  SELECT session_key, driver_number, lap_number, cum_time,
         cum_time - min(cum_time) OVER (PARTITION BY session_key, lap_number) AS gap FROM cum)"""
STINT_LAPS = """stint_laps AS (
  SELECT l.*, s.stint_number, s.compound, s.tyre_age_at_start, s.lap_start,
         l.lap_number - s.lap_start + coalesce(s.tyre_age_at_start, 0) AS tyre_age
  FROM {source} l JOIN stints s
    ON l.session_key = s.session_key AND l.driver_number = s.driver_number
   AND l.lap_number BETWEEN s.lap_start AND s.lap_end)"""
UNDERCUTS = f"""{LAPS}, {STINTS}, {GRID},
pits AS (
  SELECT DISTINCT session_key, driver_number, lap_start AS pit_lap FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key, driver_number
                                 ORDER BY stint_number) AS rn FROM stints) WHERE rn > 1),
pairs AS (
  SELECT a.session_key, a.pit_lap, a.driver_number AS a, b.driver_number AS b,
         ga.position AS a0, gb.position AS b0
  FROM pits a JOIN (SELECT DISTINCT session_key, driver_number FROM stints) b
    ON a.session_key = b.session_key AND a.driver_number <> b.driver_number
  JOIN grid ga ON ga.session_key = a.session_key AND ga.driver_number = a.driver_number
    AND ga.lap_number = a.pit_lap - 1 AND ga.position IS NOT NULL
  JOIN grid gb ON gb.session_key = a.session_key AND gb.driver_number = b.driver_number
    AND gb.lap_number = a.pit_lap - 1 AND gb.position IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM pits p WHERE p.session_key = a.session_key
                    AND p.driver_number = b.driver_number AND p.pit_lap = a.pit_lap)),
after_pit AS (
  SELECT p.*, ga.position AS a1, gb.position AS b1
  FROM pairs p CROSS JOIN (SELECT unnest([1, 2, 3]) AS o) o
  JOIN grid ga ON ga.session_key = p.session_key AND ga.driver_number = p.a
    AND ga.lap_number = p.pit_lap + o.o
  JOIN grid gb ON gb.session_key = p.session_key AND gb.driver_number = p.b
    AND gb.lap_number = p.pit_lap + o.o
  WHERE ga.position IS NOT NULL AND gb.position IS NOT NULL),
swaps AS (
  SELECT session_key, pit_lap, a, b, a0 > b0 AS behind FROM after_pit
  WHERE (a0 > b0 AND a1 < b1) OR (a0 <= b0 AND a1 >= b1)
  GROUP BY ALL),
undercuts AS (
  SELECT session_key, pit_lap AS lap, CASE WHEN behind THEN a ELSE b END AS attacking_driver,
         CASE WHEN behind THEN b ELSE a END AS defending_driver,
         CASE WHEN behind THEN 'undercut' ELSE 'overcut' END AS type FROM swaps)"""
PROJECTION = f"""{CLEAN}, {STINTS}, {GRID},
totals AS (
  SELECT session_key, driver_number, sum(lap_duration) AS elapsed, max(lap_number) AS current_lap
  FROM laps WHERE lap_duration > 0 GROUP BY 1, 2),
pace AS (
  SELECT session_key, driver_number, avg(lap_duration) AS pace FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number DESC) AS rn
    FROM clean) WHERE rn <= 5 GROUP BY 1, 2),
ages AS (
  SELECT t.session_key, t.driver_number,
         arg_max(t.current_lap - s.lap_start + s.tyre_age_at_start, s.stint_number) AS age
  FROM totals t JOIN stints s ON t.session_key = s.session_key AND t.driver_number = s.driver_number
   AND t.current_lap BETWEEN s.lap_start AND s.lap_end GROUP BY 1, 2),
wear AS (
  SELECT t.*, p.pace, coalesce(a.age, 0) AS age, g.position,
         t.current_lap < greatest(1, max(t.current_lap) OVER (PARTITION BY t.session_key) - 2) AS dnf,
         (SELECT sum(0.07 * greatest(0, coalesce(a.age, 0) + i - 20)) FROM range(1, 11) r(i)) AS extra
  FROM totals t LEFT JOIN pace p USING (session_key, driver_number)
  LEFT JOIN ages a USING (session_key, driver_number)
  LEFT JOIN grid g ON g.session_key = t.session_key AND g.driver_number = t.driver_number
    AND g.lap_number = t.current_lap),
timed AS (
  SELECT session_key, driver_number, dnf, nullif(position, 0) AS current_position,
         CASE WHEN dnf THEN CAST('inf' AS DOUBLE)
              ELSE round_even(elapsed + 10 * coalesce(pace, CAST('inf' AS DOUBLE)) + extra, 3)
         END AS projected_total_time FROM wear),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_key
                               ORDER BY dnf, projected_total_time, driver_number) AS projected_position
  FROM timed),
projection AS (
  SELECT session_key, driver_number, projected_total_time, current_position,
         CASE WHEN dnf THEN 'DNF' ELSE 'running' END AS status, projected_position,
         CASE WHEN NOT dnf THEN current_position - projected_position END AS position_change FROM ranked)"""


@query("gap_to_leader", f"""WITH {CUMULATIVE}
SELECT session_key, driver_number, lap_number, round(cum_time, 6) AS cum_time, round(gap, 6) AS gap FROM gaps""")
def gap_to_leader(spark, sf):
    return L.gap_to_leader(A.laps(spark, sf))


@query("clean_laps", f"""WITH {CLEAN}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date FROM clean""")
def clean_laps(spark, sf):
    return L.clean_laps(A.laps(spark, sf))


@query("valid_laps", f"""WITH {LAPS}, {VALID}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date FROM valid""")
def valid_laps(spark, sf):
    return L.valid_laps(A.laps(spark, sf), keep_pit_out=False)


@query("quick_laps", """WITH t AS (
  SELECT l_suppkey % 5 AS session_key, l_suppkey AS driver_number, l_partkey % 5 + 1 AS lap_number,
         sum(l_quantity) % 60 + 60 AS lap_time_seconds FROM lineitem GROUP BY 1, 2, 3)
SELECT session_key, driver_number, lap_number, lap_time_seconds FROM (
  SELECT *, min(lap_time_seconds) OVER (PARTITION BY session_key, driver_number) AS best FROM t)
WHERE lap_time_seconds <= best * 1.07""")
def quick_laps(spark, sf):
    return L.quick_laps(A.sample_laps(spark, sf), 1.07)


ALLOWED = list(range(40))


@query("restrict_drivers", f"""WITH {UNDERCUTS}
SELECT * FROM undercuts WHERE attacking_driver < 40 AND defending_driver < 40""")
def restrict_drivers(spark, sf):
    laps = A.laps(spark, sf)
    return X.detect_undercuts(laps, A.stints(laps), A.position(spark, sf), drivers=ALLOWED)


@query("distinct_drivers", """SELECT DISTINCT user_id % 5 AS session_key, user_id AS driver_number FROM events""")
def distinct_drivers(spark, sf):
    position = A.position(spark, sf)
    return L.distinct_drivers(position)


@query("rolling_pace", f"""WITH {ROLLING}
SELECT session_key, driver_number, lap_number, lap_duration, round(rolling_pace, 6) AS rolling_pace FROM rolling""")
def rolling_pace(spark, sf):
    return L.rolling_pace(A.laps(spark, sf)).select(*L.LAP, "lap_duration", "rolling_pace")


@query("rolling_pace_full_window", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date,
       CASE WHEN count(*) OVER w >= 5 THEN round(avg(lap_duration) OVER w, 6) END AS rolling_pace
FROM laps WHERE lap_duration IS NOT NULL
WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_pace_full_window(spark, sf):
    return L.rolling_pace(A.laps(spark, sf), clean=False)


@query("rolling_pace_median", f"""WITH {ROLLING}
SELECT session_key, round(median(rolling_pace), 6) AS median_rolling_pace FROM rolling GROUP BY 1""")
def rolling_pace_median(spark, sf):
    return L.rolling_pace_median(A.laps(spark, sf))


SUMMARY = f"""{LAPS}, {VALID},
summary AS (
  SELECT session_key, driver_number, avg(lap_duration) AS mean_pace, median(lap_duration) AS median_pace,
         stddev_samp(lap_duration) AS std_pace, min(lap_duration) AS fastest_lap, count(*) AS lap_count
  FROM valid GROUP BY 1, 2)"""


@query("pace_summary", f"""WITH {SUMMARY}
SELECT session_key, driver_number, round(mean_pace, 9) AS mean_pace, round(median_pace, 9) AS median_pace,
       round(std_pace, 9) AS std_pace, fastest_lap, lap_count FROM summary""", digits=9)
def pace_summary(spark, sf):
    return L.pace_summary(A.laps(spark, sf))


@query("pace_ranking_mean", f"""WITH {SUMMARY}
SELECT session_key, driver_number, round(mean_pace, 9) AS mean_pace,
       row_number() OVER (PARTITION BY session_key ORDER BY mean_pace, driver_number) AS rank FROM summary""", digits=9)
def pace_ranking_mean(spark, sf):
    return L.pace_ranking(A.laps(spark, sf)).select(*L.DRIVER, "mean_pace", "rank")


@query("pace_ranking_median", f"""WITH {SUMMARY}
SELECT session_key, driver_number, round(median_pace, 9) AS median_pace,
       row_number() OVER (PARTITION BY session_key ORDER BY median_pace DESC, driver_number) AS rank FROM summary""", digits=9)
def pace_ranking_median(spark, sf):
    ranked = L.pace_ranking(A.laps(spark, sf), by="median_pace", ascending=False)
    return ranked.select(*L.DRIVER, "median_pace", "rank")


@query("cumulative_time", f"""WITH {CUMULATIVE}
SELECT session_key, driver_number, lap_number, round(cum_time, 6) AS cum_time FROM cum""")
def cumulative_time(spark, sf):
    return L.cumulative_time(A.laps(spark, sf)).select(*L.LAP, "cum_time")


@query("last_laps", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, lap_duration, back FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number DESC) AS back
  FROM laps WHERE lap_duration > 0) WHERE back <= 5""")
def last_laps(spark, sf):
    valid = L.valid_laps(A.laps(spark, sf))
    return L.last_laps(valid).select(
        *L.LAP, "lap_duration", "back"
    )


@query("fastest_laps", f"""WITH {LAPS}
SELECT session_key, driver_number, lap_number, lap_duration, is_pit_out_lap, date FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_duration, lap_number) AS rn
  FROM laps WHERE is_pit_out_lap IS DISTINCT FROM true AND lap_duration IS NOT NULL) WHERE rn = 1""")
def fastest_laps(spark, sf):
    return L.fastest_laps(A.laps(spark, sf))


@query("latest_pace", f"""WITH {ROLLING}, {DRIVERS}
SELECT session_key, driver_number, lap_number, round(rolling_pace, 6) AS rolling_pace, rank FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.session_key ORDER BY rolling_pace, r.driver_number) AS rank
  FROM (SELECT *, max(lap_number) OVER (PARTITION BY session_key) AS last_lap FROM rolling) r
  SEMI JOIN drivers d ON r.session_key = d.session_key AND r.driver_number = d.driver_number
  WHERE lap_number = last_lap) WHERE rank <= 5""")
def latest_pace(spark, sf):
    return L.latest_pace(A.laps(spark, sf), 5, 5, A.drivers(spark, sf))


@query("latest_gaps", f"""WITH {CUMULATIVE}
SELECT session_key, driver_number, lap_number, round(gap, 6) AS gap,
       row_number() OVER (PARTITION BY session_key ORDER BY gap, driver_number) AS rank
FROM (SELECT *, max(lap_number) OVER (PARTITION BY session_key) AS last_lap FROM gaps)
WHERE lap_number = last_lap""")
def latest_gaps(spark, sf):
    return L.latest_gaps(A.laps(spark, sf))


@query("label_drivers", f"""WITH {SUMMARY}, {DRIVERS}
SELECT s.session_key, s.driver_number, lap_count,
       coalesce(d.name_acronym, CAST(s.driver_number AS VARCHAR)) AS driver_label,
       '#' || d.colour AS team_colour
FROM summary s LEFT JOIN drivers d ON s.session_key = d.session_key AND s.driver_number = d.driver_number""")
def label_drivers(spark, sf):
    summary = L.pace_summary(A.laps(spark, sf)).select(*L.DRIVER, "lap_count")
    return L.label_drivers(summary, A.drivers(spark, sf))


@query("asof_positions", f"""WITH {LAPS}, {GRID}
SELECT session_key, driver_number, date, position, lap_number FROM matched""")
def asof_positions(spark, sf):
    return P.match_positions(A.position(spark, sf), A.laps(spark, sf))


@query("lap_positions", f"""WITH {LAPS}, {GRID}
SELECT session_key, driver_number, lap_number, position FROM grid""")
def lap_positions(spark, sf):
    return P.lap_positions(A.position(spark, sf), A.laps(spark, sf))


@query("position_at", f"""WITH {LAPS}, {STINTS}, {GRID}
SELECT s.session_key, s.driver_number, s.lap_end AS lap_number, g.position
FROM (SELECT DISTINCT session_key, driver_number, lap_end FROM stints) s
LEFT JOIN grid g ON g.session_key = s.session_key AND g.driver_number = s.driver_number
 AND g.lap_number = s.lap_end""")
def position_at(spark, sf):
    laps = A.laps(spark, sf)
    asked = A.stints(laps).select(*L.DRIVER, F.col("lap_end").alias("lap_number"))
    return P.position_at(asked, A.position(spark, sf), laps)


@query("latest_position", f"""WITH {POSITION}
SELECT session_key, driver_number, position, date FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY date DESC, position DESC) AS rn
  FROM pos) WHERE rn = 1""")
def latest_position(spark, sf):
    return P.latest_position(A.position(spark, sf))


@query("laps_with_stints", f"""WITH {LAPS}, {STINTS}, {STINT_LAPS.format(source='laps')}
SELECT session_key, driver_number, lap_number, lap_duration, stint_number, compound, tyre_age FROM stint_laps""")
def laps_with_stints(spark, sf):
    laps = A.laps(spark, sf)
    joined = S.laps_with_stints(laps, A.stints(laps))
    return joined.select(*L.LAP, "lap_duration", "stint_number", "compound", "tyre_age")


@query("tyre_age", f"""WITH {LAPS}, {STINTS}, {STINT_LAPS.format(source='laps')}
SELECT session_key, driver_number, lap_number, compound, stint_number, tyre_age FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key, driver_number, lap_number
                               ORDER BY stint_number DESC) AS rn FROM stint_laps) WHERE rn = 1""")
def tyre_age(spark, sf):
    laps = A.laps(spark, sf)
    return S.tyre_age(laps, A.stints(laps))


DEGRADATION = f"""{CLEAN}, {STINTS}, {STINT_LAPS.format(source='clean')},
degradation AS (
  SELECT session_key, driver_number, stint_number, arg_min(compound, lap_number) AS compound,
         count(*) AS laps_in_stint, regr_slope(lap_duration, lap_number) AS deg_per_lap,
         avg(lap_duration) AS mean_pace
  FROM stint_laps GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("stint_degradation", f"""WITH {DEGRADATION}
SELECT session_key, driver_number, stint_number, compound, laps_in_stint,
       round(deg_per_lap, 10) AS deg_per_lap, round(mean_pace, 10) AS mean_pace FROM degradation""", digits=10)
def stint_degradation(spark, sf):
    laps = A.laps(spark, sf)
    return S.stint_degradation(laps, A.stints(laps))


@query("degradation_by_compound", f"""WITH {DEGRADATION}
SELECT session_key, upper(compound) AS compound, count(*) AS stints, CAST(sum(laps_in_stint) AS BIGINT) AS laps,
       round(avg(deg_per_lap), 9) AS mean_deg_per_lap, round(min(deg_per_lap), 9) AS min_deg_per_lap,
       round(max(deg_per_lap), 9) AS max_deg_per_lap FROM degradation GROUP BY 1, 2""", digits=9)
def degradation_by_compound(spark, sf):
    laps = A.laps(spark, sf)
    return S.degradation_by_compound(S.stint_degradation(laps, A.stints(laps)))


@query("detect_undercuts", f"""WITH {UNDERCUTS} SELECT * FROM undercuts""")
def detect_undercuts(spark, sf):
    laps = A.laps(spark, sf)
    return X.detect_undercuts(laps, A.stints(laps), A.position(spark, sf))


@query("undercuts_long_lookahead", f"""WITH {UNDERCUTS.replace('unnest([1, 2, 3])', 'unnest(range(1, 16))')} SELECT * FROM undercuts""")
def undercuts_long_lookahead(spark, sf):
    """Fifteen laps ahead: the operator has no upper limit."""
    laps = A.laps(spark, sf)
    return X.detect_undercuts(laps, A.stints(laps), A.position(spark, sf), lookahead=15)


@query("undercut_markers", f"""WITH {UNDERCUTS}, {CUMULATIVE.removeprefix(LAPS + ",")}
SELECT u.session_key, u.lap, u.attacking_driver, u.defending_driver, u.type,
       round(coalesce(g.gap, 0.0), 6) AS gap
FROM undercuts u LEFT JOIN gaps g ON g.session_key = u.session_key
 AND g.driver_number = u.attacking_driver AND g.lap_number = u.lap""")
def undercut_markers(spark, sf):
    laps = A.laps(spark, sf)
    events = X.detect_undercuts(laps, A.stints(laps), A.position(spark, sf), gaps=L.gap_to_leader(laps))
    return X.undercut_markers(events, laps).select("session_key", "attacking_driver", "lap", "defending_driver", "type", "gap")


@query("undercut_windows", f"""WITH {LAPS}, {STINTS}, {STINT_LAPS.format(source='laps')},
paired AS (
  SELECT session_key, driver_number, lap_number, lap_duration, tyre_age,
         lag(driver_number) OVER w AS target_driver, lag(lap_duration) OVER w AS ahead,
         lag(tyre_age) OVER w AS ahead_age
  FROM stint_laps WINDOW w AS (PARTITION BY session_key, lap_number
                               ORDER BY lap_duration, driver_number, stint_number))
SELECT session_key, driver_number, lap_number, target_driver, round(lap_duration - ahead, 6) AS pace_delta,
       ahead_age - tyre_age AS tyre_age_delta
FROM paired WHERE abs(lap_duration - ahead) <= 1.5 AND ahead_age - tyre_age > 0""")
def undercut_windows(spark, sf):
    laps = A.laps(spark, sf)
    return X.undercut_windows(laps, A.stints(laps))


@query("project_finish", f"""WITH {PROJECTION} SELECT * FROM projection""")
def project_finish(spark, sf):
    laps = A.laps(spark, sf)
    return X.project_finish(laps, A.stints(laps), A.position(spark, sf), laps_remaining=10)


@query("project_finish_long", f"""WITH {PROJECTION.replace('range(1, 11)', 'range(1, 121)').replace('10 * coalesce', '120 * coalesce')}
SELECT * FROM projection""")
def project_finish_long(spark, sf):
    """A hundred and twenty laps to go: the operator has no upper limit."""
    laps = A.laps(spark, sf)
    return X.project_finish(laps, A.stints(laps), A.position(spark, sf), laps_remaining=120)


@query("project_finish_gaps", f"""WITH {PROJECTION}
SELECT p.session_key, p.driver_number, p.projected_position,
       round(CASE WHEN status = 'DNF' THEN 0.0 ELSE projected_total_time - w.t END, 6) AS gap_to_winner,
       CASE WHEN status = 'DNF' THEN 'DNF'
            ELSE 'P' || coalesce(CAST(current_position AS VARCHAR), '?') || ' → P' || projected_position
       END AS change_label
FROM projection p LEFT JOIN (SELECT session_key, min(projected_total_time) AS t FROM projection
                             WHERE status <> 'DNF' GROUP BY 1) w USING (session_key)""")
def project_finish_gaps(spark, sf):
    laps = A.laps(spark, sf)
    rows = X.project_finish(laps, A.stints(laps), A.position(spark, sf), laps_remaining=10, with_gap=True)
    return rows.select(*L.DRIVER, "projected_position", "gap_to_winner", "change_label")


@query("project_finish_simple", f"""WITH {LAPS},
v AS (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number DESC) AS back
      FROM laps WHERE lap_duration > 0),
t AS (SELECT session_key, driver_number, max(lap_number) AS laps_completed, sum(lap_duration) AS elapsed,
             avg(lap_duration) FILTER (WHERE back <= 5) AS pace FROM v GROUP BY 1, 2),
p AS (SELECT session_key, driver_number, laps_completed, round_even(pace, 3) AS recent_pace,
             round_even(pace * greatest(80 - laps_completed, 0), 3) AS projected_remaining,
             round_even(elapsed + pace * greatest(80 - laps_completed, 0), 3) AS projected_total FROM t)
SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY projected_total, driver_number) AS projected_position
FROM p""")
def project_finish_simple(spark, sf):
    return X.project_finish_simple(A.laps(spark, sf), total_laps=80)


@query("grouped_median", """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median_price
FROM lineitem GROUP BY 1, 2""")
def median_price(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    return grouped_median(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")


MEETINGS = """meetings AS (SELECT n_nationkey AS meeting_key, n_name AS meeting_name, n_regionkey + 2020 AS year FROM nation),
sessions AS (SELECT o_orderkey AS session_key, CAST(o_custkey % 25 AS INTEGER) AS meeting_key,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Race' WHEN '2-HIGH' THEN 'Sprint Race' ELSE 'Practice' END AS session_name,
  o_orderstatus AS session_type, o_orderdate AS date_start FROM orders)"""


@query("resolve_sessions", f"""WITH {MEETINGS}
SELECT CAST(meeting_key AS BIGINT) AS meeting_key, session_key, session_name, session_type, date_start FROM sessions
WHERE meeting_key = (SELECT min(meeting_key) FROM meetings
                     WHERE meeting_name = 'NATION_7' AND year = (SELECT min(year) FROM meetings WHERE meeting_name = 'NATION_7'))""")
def resolve_sessions(spark, sf):
    meetings = A.meetings(spark, sf)
    year = meetings.where(F.col("meeting_name") == "NATION_7").agg(F.min("year")).scalar()
    return tables.resolve_sessions(meetings, A.sessions(spark, sf), year, "NATION_7")


@query("default_session", f"""WITH {MEETINGS}
SELECT CAST(meeting_key AS BIGINT) AS meeting_key, session_key, session_name, session_type, date_start FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_key ORDER BY
    CASE WHEN lower(session_name) LIKE '%race%' AND lower(session_name) NOT LIKE '%sprint%' THEN 0 ELSE 1 END,
    date_start, session_key) AS rn FROM sessions) WHERE rn = 1""")
def default_session(spark, sf):
    return tables.default_session(A.sessions(spark, sf))


def _runs(source: str, keys: str, order: str, value: str) -> str:
    """SQL that numbers the runs of equal values in ``source``."""
    window = f"(PARTITION BY {keys} ORDER BY {order})"
    return f"""
marked AS (SELECT *, CASE WHEN row_number() OVER {window} > 1 AND {value} IS DISTINCT FROM lag({value}) OVER {window}
                          THEN 1 ELSE 0 END AS new FROM {source}),
runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY {keys} ORDER BY {order}
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM marked)"""


@query("leader_runs", f"""WITH {CUMULATIVE},
led AS (SELECT session_key, lap_number, min(driver_number) AS leader FROM gaps WHERE gap = 0 GROUP BY 1, 2),
{_runs("led", "session_key", "lap_number", "leader")}
SELECT session_key, run, any_value(leader) AS leader, min(lap_number) AS first_lap, max(lap_number) AS last_lap,
       count(*) AS laps FROM runs GROUP BY 1, 2""")
def leader_runs(spark, sf):
    return L.leader_runs(A.laps(spark, sf))


@query("compound_runs", f"""WITH {LAPS}, {STINTS}, {STINT_LAPS.format(source="laps")},
{_runs("stint_laps", "session_key, driver_number", "lap_number", "compound")}
SELECT session_key, driver_number, run, any_value(compound) AS compound, min(lap_number) AS first_lap,
       max(lap_number) AS last_lap, count(*) AS laps FROM runs GROUP BY 1, 2, 3""")
def compound_runs(spark, sf):
    laps = A.laps(spark, sf)
    return S.compound_runs(laps, A.stints(laps))


@query("position_runs", f"""WITH {POSITION},
{_runs("pos", "session_key, driver_number", "date, position", "position")}
SELECT session_key, driver_number, run, any_value(position) AS position, min(date) AS since, max(date) AS until,
       count(*) AS reports FROM runs GROUP BY 1, 2, 3""")
def position_runs(spark, sf):
    return P.position_runs(A.position(spark, sf))
