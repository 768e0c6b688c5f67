"""Track positions: as-of matching to laps and the per-lap position grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import sequence_bucket, time_bucket
from lapspark.operators.joins import interval_join
from lapspark.operators.laps import DRIVER, LAP, SESSION
from lapspark.operators.ordered import asof_backward, exploded_range, row_number_in_order, with_neighbours, with_runs_merged
from lapspark.session import materialize


def match_positions(position: DataFrame, laps: DataFrame) -> DataFrame:
    """Each position report with the latest lap completed at or before it; unmatched are dropped."""
    marks = laps.where(F.col("date").isNotNull()).select(*LAP, "date").distinct()
    reports = position.where(F.col("date").isNotNull()).select(*DRIVER, "date", "position")
    return asof_backward(reports, marks, DRIVER, "date", ["lap_number"], time_bucket).where(
        F.col("lap_number").isNotNull()
    )


def recorded_positions(position: DataFrame, laps: DataFrame) -> DataFrame:
    """Last reported position per driver and lap; a lap with only null reports keeps a null.

    Reports of one instant are merged first (the largest position wins), so copies of a report never
    travel to the ordered match.
    """
    merged = position.groupBy(*DRIVER, "date").agg(F.max("position").alias("position"))
    reported = F.col("position").isNotNull()
    return match_positions(merged, laps).groupBy(*LAP).agg(
        F.max(F.when(reported, F.struct("date", "position")))["position"].alias("position")
    )


def lap_positions(position: DataFrame, laps: DataFrame) -> DataFrame:
    """Position of every reporting driver on every lap of the session, carried forward over gaps.

    Each recorded lap emits the laps up to the driver's next recorded one, so the work equals the
    size of the result; laps before a driver's first report stay null.
    """
    numbered = row_number_in_order(
        laps.where(F.col("lap_number").isNotNull()).select("session_key", "lap_number").distinct(),
        SESSION, ["lap_number"], sequence_bucket("lap_number"), "_i",
    )
    lap_index = materialize(numbered)
    count = lap_index.groupBy(*SESSION).agg(F.max("_i").alias("_count"))
    recorded = materialize(recorded_positions(position, laps))
    places = lap_index.join(count, SESSION)
    known = recorded.where(F.col("position").isNotNull()).join(places, ["session_key", "lap_number"])
    spans = with_neighbours(
        known, DRIVER, ["_i"], sequence_bucket("_i"), lag={"_p": F.col("_i")}, lead={"_n": F.col("_i")}
    )
    start = F.when(F.col("_has_lag"), F.col("_i")).otherwise(F.lit(1).cast("long"))
    stop = F.when(F.col("_has_lead"), F.col("_n") - 1).otherwise(F.col("_count"))
    held = spans.select(
        *DRIVER, F.col("_i").alias("_own"), F.col("position").alias("_position"), start.alias("_a"), stop.alias("_z")
    )
    grid = exploded_range(held, F.col("_a"), F.col("_z"), "_i").select(*DRIVER, "_i", F.when(F.col("_i") >= F.col("_own"), F.col("_position")).alias("position"))
    # Drivers that only ever reported nulls still get their laps, all null.
    silent = recorded.groupBy(*DRIVER).agg(F.max("position").alias("position")).where(F.col("position").isNull())
    blank = exploded_range(silent.join(count, SESSION), F.lit(1), F.col("_count"), "_i").select(*DRIVER, "_i", "position")
    grid = grid.unionByName(blank)
    return grid.join(lap_index, ["session_key", "_i"]).select(*LAP, "position")


def position_spans(position: DataFrame, laps: DataFrame) -> DataFrame:
    """Each reported position with the laps ``from_lap`` to ``to_lap`` it holds for; spans of a driver never overlap.

    The last one ends with the session. Lookups on spans need no row per driver and lap.
    """
    last = laps.groupBy(*SESSION).agg(F.max("lap_number").alias("_session_last"))
    known = recorded_positions(position, laps).where(F.col("position").isNotNull())
    spans = with_neighbours(
        known, DRIVER, ["lap_number"], sequence_bucket("lap_number"), lead={"_n": F.col("lap_number")}
    )
    to_lap = F.when(F.col("_has_lead"), F.col("_n") - 1).otherwise(F.col("_session_last"))
    return spans.join(last, SESSION).select(
        *DRIVER, F.col("lap_number").alias("from_lap"), to_lap.alias("to_lap"), "position"
    )


def _driven(rows: DataFrame, laps: DataFrame) -> DataFrame:
    """Rows whose lap somebody of the session has driven; a position is defined on those only."""
    keys = ["session_key", "lap_number"]
    return rows.join(laps.select(*keys).distinct(), keys, "left_semi")


def session_positions(wanted: DataFrame, position: DataFrame, laps: DataFrame) -> DataFrame:
    """Every driver's known position on the wanted laps of a session (``session_key, lap_number``, more columns stay)."""
    return interval_join(
        _driven(wanted, laps), position_spans(position, laps), SESSION, "lap_number", "from_lap", "to_lap"
    ).drop("from_lap", "to_lap")


def position_at(requests: DataFrame, position: DataFrame, laps: DataFrame) -> DataFrame:
    """Position for requested (driver, lap) rows; null when unknown."""
    asked = requests.select(*LAP).distinct()
    found = interval_join(
        _driven(asked, laps), position_spans(position, laps), DRIVER, "lap_number", "from_lap", "to_lap"
    )
    return asked.join(found.select(*LAP, "position"), LAP, "left")


def latest_position(position: DataFrame) -> DataFrame:
    """Most recent non-null position per driver."""
    return (
        position.where(F.col("position").isNotNull())
        .groupBy(*DRIVER)
        .agg(F.max(F.struct("date", "position")).alias("_last"))
        .select(*DRIVER, F.col("_last.position").alias("position"), F.col("_last.date").alias("date"))
    )


def position_runs(position: DataFrame) -> DataFrame:
    """Reports in a row of a driver with one position: ``…, run, position, since, until, reports``.

    Reports without a position are left out; of those of one instant the smaller position comes first.
    """
    known = position.where(F.col("position").isNotNull()).select(*DRIVER, "date", "position")
    known = known.withColumn("_place", F.col("position"))
    runs = with_runs_merged(known, DRIVER, ["date", "_place"], time_bucket("date"), "position")
    return runs.select(
        *DRIVER, "run", "position", F.col("first_date").alias("since"), F.col("last_date").alias("until"),
        F.col("length").alias("reports"),
    )


def position_on_lap(cutoffs: DataFrame, position: DataFrame, laps: DataFrame, lap: str) -> DataFrame:
    """Last known position at or before one lap per driver (``cutoffs`` has one row per driver)."""
    known = recorded_positions(position, laps).where(F.col("position").isNotNull())
    return (
        known.join(cutoffs.select(*DRIVER, lap), DRIVER)
        .where(F.col("lap_number") <= F.col(lap))
        .groupBy(*DRIVER)
        .agg(F.max_by("position", "lap_number").alias("current_position"))
    )
