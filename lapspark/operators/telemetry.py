"""Telemetry: distance, resampling on a grid, lap features and mean traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import (
    add_seconds,
    at_least,
    computed_once,
    elapsed_seconds,
    fraction_of_points,
    micros,
    nan_to_null,
    sequence_bucket,
    time_bucket,
)
from lapspark.operators.joins import join_per_key
from lapspark.operators.laps import DRIVER, LAP, fastest_laps, quick_laps, top_per_key
from lapspark.operators.ordered import BUCKET, row_number_in_order, with_neighbours, with_running
from lapspark.schemas import MIN_SAMPLES_PER_LAP, OUTLINE_POINTS, TRACE_POINTS
from lapspark.session import materialize

#: Indices of a mean trace that are averaged in one row.
MEANS_PER_ROW = 8
CHANNELS = ["speed", "throttle", "brake", "n_gear", "rpm", "x", "y", "steer"]


def with_channels(samples: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Absent channels become null columns and NaN becomes null."""
    return samples.withColumns(
        {
            c: nan_to_null(F.col(c).cast("double")) if c in samples.columns else F.lit(None).cast("double")
            for c in channels
        }
    )


def _bucket_of(samples: DataFrame, order: str) -> Column:
    """The bucket samples are dealt by already (``with_running(keep_bucket=True)``), else a chunk of ``order``."""
    return F.col(BUCKET) if BUCKET in samples.columns else sequence_bucket(order)


def _grid_point(first: Column, last: Column, points: int, k: Column) -> Column:
    step = (last - first) / F.lit(float(points - 1))
    return F.when(k == points - 1, last).otherwise(k * step + first)


def resample(
    samples: DataFrame,
    keys: Sequence[str],
    order: str,
    axis: str,
    channels: Sequence[str],
    points: int = TRACE_POINTS,
    bucket: Column | None = None,
    min_samples: int = 1,
) -> DataFrame:
    """Linear interpolation of the channels on ``points`` evenly spaced axis positions per key.

    Every sample emits the grid points between itself and its successor (the last sample emits the
    rest), so there is no join and the cost is linear in samples plus grid points. ``axis`` must not
    decrease along ``order``; see :func:`axis_violations`. Keys with fewer than ``min_samples``
    samples are left out. Samples that carry their ``_bucket`` stay dealt by it.
    """
    cells = _resampled(samples, keys, order, axis, channels, points, bucket, min_samples)
    return cells.drop(BUCKET)


def _resampled(
    samples: DataFrame, keys: Sequence[str], order: str, axis: str, channels: Sequence[str], points: int,
    bucket: Column | None, min_samples: int,
) -> DataFrame:
    """``resample`` with the ``_bucket`` by which the grid points are dealt."""
    at_least(2, points=points)
    rows = with_channels(samples, channels).withColumn(axis, nan_to_null(F.col(axis).cast("double")))
    rows = rows.withColumn(BUCKET, _bucket_of(samples, order) if bucket is None else bucket)
    rows = rows.where(F.col(axis).isNotNull()).select(*keys, order, axis, *channels, BUCKET)
    here = {"_x1": F.col(axis), **{f"_n_{c}": F.col(c) for c in channels}}
    rows = with_neighbours(
        rows, keys, [order], F.col(BUCKET),
        lead=here, first={"_d0": F.col(axis)}, last={"_dn": F.col(axis)}, rows_name="_rows", keep_bucket=True,
    )
    d0, dn, x0, x1 = F.col("_d0"), F.col("_dn"), F.col(axis), F.col("_x1")
    step = F.nullif((dn - d0) / F.lit(float(points - 1)), F.lit(0.0))
    # Candidate indices by division, widened by a sliver and then compared with the exact grid.
    low = F.coalesce(F.ceil((x0 - d0) / step - 1e-6), F.lit(0).cast("long")).cast("int")
    high = F.when(F.col("_has_lead"), F.floor((x1 - d0) / step + 1e-6).cast("int")).otherwise(F.lit(points - 1))
    used = (F.col("_rows") >= min_samples) & (~F.col("_has_lead") | (x1 > x0))
    cells = rows.where(used).withColumn(
        "k", F.explode(F.when(low <= high, F.sequence(low, F.least(high, F.lit(points - 1)))))
    )
    at = _grid_point(d0, dn, points, F.col("k"))
    cells = cells.where((at >= x0) & (~F.col("_has_lead") | (at < x1)))

    def value(c: str) -> Column:
        slope = (F.col(f"_n_{c}") - F.col(c)) / (x1 - x0)
        return F.when(F.col("_has_lead"), slope * (at - x0) + F.col(c)).otherwise(F.col(c))

    return cells.select(*keys, BUCKET, "k", at.alias("grid"), *[value(c).alias(c) for c in channels])


def axis_violations(
    samples: DataFrame, keys: Sequence[str], order: str, axis: str
) -> DataFrame:
    """Laps whose axis decreases somewhere: they cannot be resampled and should be reported."""
    placed = samples.withColumn(BUCKET, _bucket_of(samples, order))
    placed = placed.where(F.col(axis).isNotNull()).select(*keys, order, axis, BUCKET)
    rows = with_neighbours(placed, keys, [order], F.col(BUCKET), lag={"_before": F.col(axis)})
    return (
        rows.where(F.col(axis) < F.col("_before"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("decreasing_steps"))
    )


def _changes(arr: Column, differs) -> Column:
    """Number of adjacent pairs for which ``differs(previous, current)`` holds."""
    pairs = F.zip_with(
        F.slice(arr, F.lit(1), F.size(arr) - 1), F.slice(arr, F.lit(2), F.size(arr) - 1), differs
    )
    return F.when(F.size(arr) > 1, F.size(F.filter(pairs, lambda p: p))).otherwise(F.lit(0))


def lap_traces(grid: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Pack resampled rows (a fixed number per lap) into one array per channel."""
    packed = grid.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("k", *channels))).alias("_points")
    )
    return packed.select(*keys, *[F.col("_points")[c].alias(f"{c}_trace") for c in channels])


def lap_features(
    samples: DataFrame,
    keys: Sequence[str] = tuple(LAP),
    order: str = "sample_no",
    axis: str = "distance",
    points: int = TRACE_POINTS,
) -> DataFrame:
    """Scalar features and traces of every lap from its resampled channels.

    The points of a bucket are packed where they were made, into one plain array per channel; a lap's buckets (mostly one)
    are put together afterwards. So the one shuffle by lap carries eight bytes a value, and only the traces that are read.
    """
    used = ["speed", "throttle", "brake", "n_gear", "x", "y", "steer"]
    averaged, spread, traces = ["speed", "throttle", "brake"], ["throttle", "steer"], ["speed", "throttle", "brake", "x", "y"]
    grid = _resampled(samples, keys, order, axis, used, points, None, MIN_SAMPLES_PER_LAP)
    packed = grid.groupBy(*keys, BUCKET).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in averaged], *[F.count(c).alias(f"_n_{c}") for c in averaged],
        F.max("speed").alias("_max"), F.min("speed").alias("_min"),
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f"_m_{c}") for c in spread],
        F.sort_array(F.collect_list(F.struct("k", *traces, "n_gear"))).alias("_p"),
    )
    start = F.col("_p")[0]["k"].alias("_k")
    on = F.transform(F.col("_p")["brake"], lambda b: F.coalesce(b > 0, F.lit(False)))
    gear = F.transform(F.col("_p")["n_gear"], lambda g: F.bround(g))
    braked = lambda a, b: ~a & b
    # A missing gear counts as a change between every pair of points, like NaN != 0 does.
    shifted = lambda a, b: ~F.coalesce(a == b, F.lit(False))

    def part(values: Column, differs) -> Column:
        return F.struct(
            start, _changes(values, differs).alias("inside"), values[0].alias("head"), F.element_at(values, -1).alias("tail"))

    parts = packed.withColumns(
        {
            **{f"_t_{c}": F.struct(start, F.col("_p")[c].alias("values")) for c in traces},
            **{f"_m_{c}": F.struct(start, F.col(f"_m_{c}").alias("moments")) for c in spread},
            "_on": part(on, braked), "_gear": part(gear, shifted),
        }
    )
    lists = [*[f"_t_{c}" for c in traces], *[f"_m_{c}" for c in spread], "_on", "_gear"]
    laps = parts.groupBy(*keys).agg(
        *[(F.sum(f"_sum_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(f"_avg_{c}") for c in averaged],
        F.max("_max").alias("max_speed"), F.min("_min").alias("min_speed"),
        *[F.sort_array(F.collect_list(c)).alias(c) for c in lists],
    )

    def events(c: str, differs) -> Column:
        inside = F.aggregate(c, F.lit(0), lambda n, p: n + p["inside"])
        between = F.zip_with(
            F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: differs(a["tail"], b["head"]))
        return inside + F.when(F.size(c) > 1, F.size(F.filter(between, lambda p: p))).otherwise(F.lit(0))

    return laps.select(
        *keys,
        F.col("_avg_speed").alias("mean_speed"), "max_speed", "min_speed", F.col("_avg_throttle").alias("throttle_mean"),
        _deviation("_m_throttle").alias("throttle_std"), F.col("_avg_brake").alias("brake_mean"),
        events("_on", braked).alias("brake_events"),
        events("_gear", shifted).alias("gear_changes"),
        F.coalesce(_deviation("_m_steer"), F.lit(0.0)).alias("steer_std"),
        *[F.flatten(F.col(f"_t_{c}")["values"]).alias(f"{c}_trace") for c in traces],
    )


def _deviation(parts: str) -> Column:
    """Population deviation from the count, mean and variance of each part, merged one after the other."""
    def merged(s: Column, p: Column) -> Column:
        n = s["n"] + p["moments"]["n"]
        away = p["moments"]["mean"] - s["mean"]
        share = p["moments"]["n"] / n
        square = p["moments"]["var"] * p["moments"]["n"] + away * away * s["n"] * share
        whole = F.struct(
            n.cast("double").alias("n"), (s["mean"] + away * share).alias("mean"), (s["square"] + square).alias("square"))
        return F.when(p["moments"]["n"] > 0, whole).otherwise(s)

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "square")])
    return F.aggregate(parts, zero, merged, lambda s: F.sqrt(s["square"] / F.nullif(s["n"], F.lit(0.0))))


def timed_lap_features(
    samples: DataFrame, lap_times: DataFrame, ratio: float, keys: Sequence[str] = tuple(LAP)
) -> DataFrame:
    """Features of quick laps together with their lap time: the training table."""
    quick = quick_laps(lap_times, ratio).select(*keys, "lap_time_seconds")
    kept = samples.join(quick.select(*keys), list(keys), "left_semi")
    return lap_features(kept, keys).join(quick, list(keys))


def extended_features(laps: DataFrame) -> DataFrame:
    """Coasting, full-throttle and trail-braking shares of each lap's trace points."""
    both = F.arrays_zip(
        F.transform("throttle_trace", nan_to_null).alias("t"),
        F.transform("brake_trace", nan_to_null).alias("b"),
    )
    rules = {
        "coasting_pct": lambda p: (p["t"] < 2) & (p["b"] < 1),
        "throttle_pickup_pct": lambda p: p["t"] > 80,
        "trail_brake_score": lambda p: (p["t"] > 0) & (p["b"] > 0),
    }
    shares = computed_once(both, lambda z: F.struct(*[fraction_of_points(z, rule).alias(name) for name, rule in rules.items()]))
    return laps.withColumn("_shares", shares).withColumns({name: F.col("_shares")[name] for name in rules}).drop("_shares")


def distance_proxy(
    samples: DataFrame, keys: Sequence[str] = tuple(DRIVER), seconds: int = 300
) -> DataFrame:
    """Distance as the running integral of the *previous* speed over time, plus elapsed seconds.

    Samples of one instant follow each other by speed.
    """
    bucket = time_bucket("date", seconds)
    rows = with_neighbours(
        samples.where(F.col("date").isNotNull()), keys, ["date", "speed"], bucket,
        lag={"_v": nan_to_null(F.col("speed").cast("double")), "_t": F.col("date")},
        first={"_start": F.col("date")},
    )
    step = F.coalesce(F.col("_v") / 3.6 * elapsed_seconds(F.col("date"), F.col("_t")), F.lit(0.0))
    rows = with_running(
        rows.withColumn("_step", step), keys, ["date", "speed"], time_bucket("date", seconds),
        sums={"distance": F.col("_step")},
    )
    rows = rows.withColumn("elapsed", elapsed_seconds(F.col("date"), F.col("_start")))
    return rows.drop("_v", "_t", "_start", "_step", "_has_lag", "_has_lead")


def fastest_lap_samples(
    laps: DataFrame, car_data: DataFrame, slack_seconds: float = 0.5
) -> DataFrame:
    """Car data of each driver's fastest lap, both ends inclusive, with a small tail.

    There is one window per driver, so car data meets it in a plain join with the range as a filter: at most one shuffle
    of car data, none where the windows are small enough to be broadcast.
    """
    best = fastest_laps(laps).where(F.col("date_start").isNotNull())
    begin = micros("date_start")
    windows = best.select(
        *DRIVER,
        F.col("lap_number"),
        F.col("lap_duration").alias("lap_time"),
        begin.alias("_from"),
        micros(add_seconds(F.col("date_start"), F.col("lap_duration") + slack_seconds)).alias("_to"),
    )
    points = car_data.where(F.col("date").isNotNull()).withColumn("_at", micros("date"))
    inside = join_per_key(points, windows, DRIVER).where(F.col("_at").between(F.col("_from"), F.col("_to")))
    return inside.drop("_at", "_from", "_to")


def fastest_lap_traces(
    laps: DataFrame, car_data: DataFrame, points: int = TRACE_POINTS
) -> DataFrame:
    """Speed, throttle, brake and elapsed time of every driver's fastest lap on a common grid.

    Elapsed time is interpolated on the sample index because distance may stand still.
    """
    samples = materialize(distance_proxy(materialize(fastest_lap_samples(laps, car_data))))
    info = samples.groupBy(*DRIVER).agg(
        F.max("lap_time").alias("lap_time"),
        F.max("lap_number").alias("lap_number"),
        F.count(F.lit(1)).alias("_n"),
    ).where(F.col("_n") >= 2)
    by_distance = resample(
        samples.withColumn("_us", micros("date")), DRIVER, "_us", "distance",
        ["speed", "throttle", "brake"], points, bucket=F.floor(F.col("_us") / 300_000_000),
    )
    numbered = row_number_in_order(samples, DRIVER, ["date", "speed"], time_bucket("date"), "_i")
    by_index = resample(
        numbered.withColumn("_x", F.col("_i").cast("double")), DRIVER, "_i", "_x", ["elapsed"], points
    )
    traces = lap_traces(by_distance, DRIVER, ["speed", "throttle", "brake"]).join(
        lap_traces(by_index, DRIVER, ["elapsed"]), DRIVER
    )
    return traces.join(info.drop("_n"), DRIVER).withColumnRenamed("elapsed_trace", "cumtime")


def mean_trace(laps: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Element-wise mean of traces over a driver's laps, in long form (one row per index).

    The laps are averaged map-side, so a driver with very many laps shuffles only partial sums, ``MEANS_PER_ROW`` indices
    to a row.
    """
    clean = laps.select(*keys, F.arrays_zip(*[F.transform(c, nan_to_null).alias(c) for c in columns]).alias("_z"))
    size = F.size("_z")
    pieces = F.sequence(F.lit(0), F.floor((size - 1) / MEANS_PER_ROW).cast("int"))
    pieces = clean.withColumn("_piece", F.explode(F.when(size > 0, pieces)))
    slots = {f"_{i}_{c}": (i, c) for i in range(MEANS_PER_ROW) for c in columns}
    here = F.col("_piece") * MEANS_PER_ROW
    # ``get`` is null beyond the end, which no mean counts.
    means = pieces.groupBy(*keys, "_piece").agg(
        F.max(size).alias("_size"), *[F.avg(F.get("_z", here + i)[c]).alias(s) for s, (i, c) in slots.items()])
    points = F.array(*[
        F.struct((here + i).alias("k"), *[F.col(f"_{i}_{c}").alias(c) for c in columns]) for i in range(MEANS_PER_ROW)])
    return means.select(*keys, F.inline(F.filter(points, lambda p: p["k"] < F.col("_size"))))


def pack_trace(long: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long mean traces back to one array per column (array length is the fixed grid size)."""
    packed = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", *columns))).alias("_p"))
    return packed.select(*keys, *[F.col("_p")[c].alias(c) for c in columns])


def zone_means(laps: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Mean over three index zones [0, 67), [67, 134), [134, 200) of all the driver's laps."""
    points = laps.select(*keys, F.posexplode(F.transform(column, nan_to_null)).alias("k", "_v"))
    zone = F.when(F.col("k") < 67, 1).when(F.col("k") < 134, 2).when(F.col("k") < 200, 3)
    return (
        points.where(F.col("k") < 200).groupBy(*keys, zone.alias("zone")).agg(F.avg("_v").alias("zone_mean"))
    )


def throttle_map(laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean x, y and throttle at each grid index."""
    return mean_trace(laps, keys, ["x_trace", "y_trace", "throttle_trace"])


def representative_lap(laps: DataFrame, ratio: float, group: str = "session_key") -> DataFrame:
    """The fastest quick lap of the driver with the most laps (ties: lowest driver)."""
    counts = laps.where(F.col("lap_number").isNotNull()).groupBy(group, "driver_number").agg(
        F.count("lap_number").alias("_laps")
    )
    busiest = top_per_key(counts, [group], [F.desc("_laps"), F.asc("driver_number")], 1, "_r")
    theirs = laps.join(busiest.select(group, "driver_number"), [group, "driver_number"])
    return (
        quick_laps(theirs, ratio)
        .groupBy(group, "driver_number")
        .agg(F.min_by("lap_number", F.struct("lap_time_seconds", "lap_number")).alias("lap_number"))
    )


def circuit_outline(
    samples: DataFrame, laps: DataFrame, ratio: float, points: int = OUTLINE_POINTS
) -> DataFrame:
    """X/Y outline of the track from the representative lap, in long form."""
    lap = representative_lap(laps, ratio)
    kept = samples.join(lap, LAP, "left_semi")
    return resample(kept, LAP, "sample_no", "distance", ["x", "y"], points)
