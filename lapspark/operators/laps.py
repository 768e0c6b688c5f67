"""Lap filters, rolling pace, cumulative time and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import add_seconds, at_least, nan_to_null, sequence_bucket, value_bucket
from lapspark.operators.ordered import first_rows, rolling_mean, row_number_in_order, with_running, with_runs_merged
from lapspark.operators.quantiles import grouped_median
from lapspark.schemas import SAFETY_CAR_RATIO
from lapspark.session import materialize

SESSION = ["session_key"]
DRIVER = ["session_key", "driver_number"]
LAP = ["session_key", "driver_number", "lap_number"]


def normalise_laps(laps: DataFrame) -> DataFrame:
    """NaN durations become null; the lap's end time is derived when only its start is known."""
    out = laps.withColumn("lap_duration", nan_to_null(F.col("lap_duration").cast("double")))
    if "date_start" in out.columns:
        end = add_seconds(F.col("date_start"), F.col("lap_duration"))
        out = out.withColumn("date", F.coalesce("date", end) if "date" in out.columns else end)
    return out


def valid_laps(laps: DataFrame, keep_pit_out: bool = True) -> DataFrame:
    """Laps with a positive duration, optionally without pit-out laps (a null flag is kept)."""
    # NaN ranks above every number, so it has to become null before the comparison.
    out = laps.where(nan_to_null(F.col("lap_duration")) > 0)
    if not keep_pit_out and "is_pit_out_lap" in laps.columns:
        out = out.where(~F.col("is_pit_out_lap").eqNullSafe(True))
    return out


def clean_laps(laps: DataFrame, sc_ratio: float = SAFETY_CAR_RATIO) -> DataFrame:
    """Valid racing laps no slower than ``sc_ratio`` times the session median."""
    valid = valid_laps(laps, keep_pit_out=False)
    limits = grouped_median(valid, SESSION, "lap_duration", "_median")
    return (
        valid.join(limits, SESSION)
        .where(F.col("lap_duration") <= F.col("_median") * sc_ratio)
        .drop("_median")
    )


def quick_laps(laps: DataFrame, ratio: float, lap_time: str = "lap_time_seconds") -> DataFrame:
    """Laps within ``ratio`` of the driver's own best."""
    timed = laps.where(nan_to_null(F.col(lap_time)).isNotNull())
    best = timed.groupBy(*DRIVER).agg(F.min(lap_time).alias("_best"))
    return (
        timed.join(best, DRIVER)
        .where(F.col(lap_time) <= F.col("_best") * ratio)
        .drop("_best")
    )


def restrict_drivers(df: DataFrame, drivers: Sequence | None, *columns: str) -> DataFrame:
    """Keep rows whose driver columns are all in the allow-list; no list keeps everything."""
    if drivers is None:
        return df
    for c in columns or ("driver_number",):
        df = df.where(F.col(c).isin(list(drivers)))
    return df


def parse_driver_codes(text: str) -> list[str]:
    return [p.strip().upper() for p in text.split(",") if p.strip()]


def rolling_pace(
    laps: DataFrame, window: int = 5, min_periods: int | None = None, clean: bool = True
) -> DataFrame:
    """Rolling mean over the last ``window`` *rows* of each driver.

    ``clean=True`` runs on clean laps with partial windows allowed; ``clean=False`` only drops null
    durations and, unless told otherwise, needs a full window.
    """
    at_least(1, window=window)
    if clean:
        rows = materialize(clean_laps(laps).select(*LAP, "lap_duration"))
        periods = 1 if min_periods is None else min_periods
    else:
        rows = laps.where(nan_to_null(F.col("lap_duration")).isNotNull())
        periods = window if min_periods is None else min_periods
    return rolling_mean(
        rows, DRIVER, ["lap_number", "lap_duration"], sequence_bucket("lap_number"),
        "lap_duration", "rolling_pace", window, periods,
    )


def rolling_pace_median(laps: DataFrame, window: int = 5) -> DataFrame:
    return grouped_median(rolling_pace(laps, window), SESSION, "rolling_pace", "median_rolling_pace")


def pace_summary(laps: DataFrame) -> DataFrame:
    """Per-driver mean, median, sample deviation, fastest and count, without pit-out laps."""
    valid = valid_laps(laps, keep_pit_out=False)
    stats = valid.groupBy(*DRIVER).agg(
        F.avg("lap_duration").alias("mean_pace"),
        F.stddev_samp("lap_duration").alias("std_pace"),
        F.min("lap_duration").alias("fastest_lap"),
        F.count("lap_duration").alias("lap_count"),
    )
    return stats.join(grouped_median(valid, DRIVER, "lap_duration", "median_pace"), DRIVER)


def pace_ranking(
    laps: DataFrame, by: str = "mean_pace", ascending: bool = True, drivers: Sequence | None = None
) -> DataFrame:
    """Rank of each driver in the session by a pace statistic."""
    summary = materialize(restrict_drivers(pace_summary(laps), drivers))
    key = F.col(by) if ascending else -F.col(by)
    ranked = row_number_in_order(
        summary.withColumn("_key", key), SESSION, ["_key", "driver_number"], value_bucket("_key"), "rank"
    )
    return ranked.drop("_key")


def cumulative_time(laps: DataFrame) -> DataFrame:
    """Running race time of each driver over all valid laps."""
    return with_running(
        valid_laps(laps), DRIVER, ["lap_number", "lap_duration"], sequence_bucket("lap_number"),
        sums={"cum_time": F.col("lap_duration")},
    )


def gap_to_leader(laps: DataFrame) -> DataFrame:
    """Gap of each driver to the lowest cumulative time among the drivers present on a lap.

    Repeated rows of a lap are added up first: the last of them carries the whole sum anyway.
    """
    per_lap = valid_laps(laps).groupBy(*LAP).agg(F.sum("lap_duration").alias("_sum"))
    timed = with_running(
        per_lap, DRIVER, ["lap_number"], sequence_bucket("lap_number"), sums={"cum_time": F.col("_sum")}
    )
    timed = materialize(timed.select(*LAP, "cum_time"))
    leader = timed.groupBy("session_key", "lap_number").agg(F.min("cum_time").alias("_leader"))
    return timed.join(leader, ["session_key", "lap_number"]).select(
        *LAP, "cum_time", (F.col("cum_time") - F.col("_leader")).alias("gap")
    )


def leader_runs(laps: DataFrame) -> DataFrame:
    """Laps in a row led by one driver: ``session_key, run, leader, first_lap, last_lap, laps``.

    A lap's leader has the lowest cumulative time of those who drove it (ties to the smaller number); laps nobody
    drove do not end a run.
    """
    ahead = gap_to_leader(laps).where(F.col("gap") == 0).groupBy(*SESSION, "lap_number")
    led = ahead.agg(F.min("driver_number").alias("leader"))
    runs = with_runs_merged(led, SESSION, ["lap_number"], sequence_bucket("lap_number"), "leader")
    return runs.select(
        *SESSION, "run", "leader", F.col("first_lap_number").alias("first_lap"),
        F.col("last_lap_number").alias("last_lap"), F.col("length").alias("laps"),
    )


def pivot_by_driver(df: DataFrame, value: str, drivers: Sequence[int]) -> DataFrame:
    """Wide lap-by-driver matrix for a known list of drivers."""
    return (
        df.groupBy("session_key", "lap_number").pivot("driver_number", list(drivers)).agg(F.first(value))
    )


def _latest(df: DataFrame, value: str) -> DataFrame:
    last = df.groupBy(*SESSION).agg(F.max("lap_number").alias("_last"))
    return df.join(last, SESSION).where(
        F.col("lap_number") == F.col("_last")
    ).select(*LAP, value)


def _known(df: DataFrame, drivers: DataFrame | None) -> DataFrame:
    if drivers is None:
        return df
    keys = drivers.select(*DRIVER).distinct()
    return df.join(keys, DRIVER, "left_semi")


def latest_pace(
    laps: DataFrame, window: int = 5, top_n: int = 5, drivers: DataFrame | None = None
) -> DataFrame:
    """Drivers present on the session's last lap by rolling pace; ``top_n`` per session."""
    at_least(1, window=window, top_n=top_n)
    pace = _known(_latest(rolling_pace(laps, window), "rolling_pace"), drivers)
    return top_per_key(pace, SESSION, [F.col("rolling_pace"), F.col("driver_number")], top_n, "rank")


def latest_gaps(laps: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    gaps = materialize(_known(_latest(gap_to_leader(laps), "gap"), drivers))
    return row_number_in_order(gaps, SESSION, ["gap", "driver_number"], value_bucket("gap"), "rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str) -> DataFrame:
    """First ``n`` rows per key. Spark limits every input partition to ``n`` rows per key before
    the shuffle (window group limit), so a hot key never reaches one task whole."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(name) <= n
    )


#: From this number of rows on, Spark does not limit the input partitions of a window.
GROUP_LIMIT = 1000


def last_laps(laps: DataFrame, n: int = 5, name: str = "back") -> DataFrame:
    """Each driver's last ``n`` laps, numbered backwards; of equal lap numbers the longer lap comes first."""
    at_least(1, n=n)
    order = [F.desc("lap_number"), F.desc("lap_duration")]
    if n < GROUP_LIMIT:
        return top_per_key(laps, DRIVER, order, n, name)
    return first_rows(laps, DRIVER, order, n, sequence_bucket("lap_number", descending=True), name)


def distinct_drivers(df: DataFrame, column: str = "driver_number") -> DataFrame:
    return df.where(F.col(column).isNotNull()).select("session_key", column).distinct()


def fastest_laps(laps: DataFrame) -> DataFrame:
    """Each driver's shortest lap that is not a pit-out lap (non-positive times are not excluded)."""
    rows = laps.where(nan_to_null(F.col("lap_duration")).isNotNull())
    if "is_pit_out_lap" in laps.columns:
        rows = rows.where(~F.col("is_pit_out_lap").eqNullSafe(True))
    kept = [c for c in rows.columns if c not in DRIVER]
    best = F.min_by(F.struct(*kept), F.struct("lap_duration", "lap_number")).alias("_best")
    return rows.where(F.col("driver_number").isNotNull()).groupBy(*DRIVER).agg(best).select(
        *DRIVER, "_best.*"
    )


def label_drivers(df: DataFrame, drivers: DataFrame, how: str = "left", column: str = "driver_number") -> DataFrame:
    """Add the driver's short name; ``how='left'`` falls back to the number as text."""
    names = drivers.groupBy(F.col("session_key"), F.col("driver_number").alias(column)).agg(
        F.max("name_acronym").alias("_acronym"), F.max("team_colour").alias("_colour")
    )
    out = df.join(names, ["session_key", column], how)
    label = F.col("_acronym") if how == "inner" else F.coalesce("_acronym", F.col(column).cast("string"))
    colour = F.concat(F.lit("#"), F.upper("_colour"))
    return out.withColumns({"driver_label": label, "team_colour": colour}).drop("_acronym", "_colour")
