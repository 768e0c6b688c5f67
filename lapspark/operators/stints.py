"""Tyre stints: range join with laps, tyre age and degradation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import nan_to_null, sequence_bucket
from lapspark.operators.joins import interval_join
from lapspark.operators.laps import DRIVER, LAP, clean_laps
from lapspark.operators.ordered import with_runs_merged

STINT_COLUMNS = ["stint_number", "compound", "tyre_age_at_start", "lap_start", "lap_end"]


def laps_with_stints(laps: DataFrame, stints: DataFrame) -> DataFrame:
    """Laps with the stint covering them; overlapping stints give one row each."""
    covered = interval_join(
        laps, stints.select(*DRIVER, *STINT_COLUMNS), DRIVER, "lap_number", "lap_start", "lap_end"
    )
    if "tyre_age" not in laps.columns:
        covered = covered.withColumn(
            "tyre_age",
            F.col("lap_number") - F.col("lap_start") + F.coalesce("tyre_age_at_start", F.lit(0)),
        )
    return covered


def tyre_age(laps: DataFrame, stints: DataFrame) -> DataFrame:
    """Compound, stint and tyre age on each lap, from the last stint covering it."""
    points = laps.where(F.col("lap_number").isNotNull()).select(*LAP).distinct()
    info = F.struct("stint_number", "lap_start", "compound", "tyre_age")
    return (
        laps_with_stints(points, stints)
        .groupBy(*LAP)
        .agg(F.max_by(info, F.struct("stint_number", "lap_start")).alias("_s"))
        .select(*LAP, "_s.compound", "_s.stint_number", "_s.tyre_age")
    )


def compound_runs(laps: DataFrame, stints: DataFrame) -> DataFrame:
    """Laps in a row of a driver on one compound, over stints of the same compound too.

    Gives ``session_key, driver_number, run, compound, first_lap, last_lap, laps``; laps without a stint are left out and
    do not end a run.
    """
    fitted = tyre_age(laps, stints)
    runs = with_runs_merged(fitted, DRIVER, ["lap_number"], sequence_bucket("lap_number"), "compound")
    return runs.select(
        *DRIVER, "run", "compound", F.col("first_lap_number").alias("first_lap"),
        F.col("last_lap_number").alias("last_lap"), F.col("length").alias("laps"),
    )


def stint_degradation(laps: DataFrame, stints: DataFrame, clean: bool = True) -> DataFrame:
    """Least-squares slope of duration on lap number for every stint with at least three laps."""
    rows = clean_laps(laps) if clean else laps
    joined = laps_with_stints(rows.where(nan_to_null(F.col("lap_duration")).isNotNull()), stints)
    return (
        joined.where(F.col("stint_number").isNotNull())
        .groupBy(*DRIVER, "stint_number")
        .agg(
            F.min_by("compound", "lap_number").alias("compound"),
            F.count(F.lit(1)).alias("laps_in_stint"),
            F.regr_slope("lap_duration", "lap_number").alias("deg_per_lap"),
            F.avg("lap_duration").alias("mean_pace"),
        )
        .where(F.col("laps_in_stint") >= 3)
    )


def degradation_by_compound(degradation: DataFrame) -> DataFrame:
    """Degradation figures grouped by tyre compound (stints without a compound are left out)."""
    return (
        degradation.where(F.col("compound").isNotNull())
        .groupBy("session_key", F.upper("compound").alias("compound"))
        .agg(
            F.count(F.lit(1)).alias("stints"),
            F.sum("laps_in_stint").alias("laps"),
            F.avg("deg_per_lap").alias("mean_deg_per_lap"),
            F.min("deg_per_lap").alias("min_deg_per_lap"),
            F.max("deg_per_lap").alias("max_deg_per_lap"),
        )
    )
