"""Comparison of two laps point by point. A pair has a fixed number of points (200 or 1000)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import upsample
from lapspark.schemas import DISPLAY_POINTS

PAIR = ["session_key", "driver_a", "driver_b"]


def lap_pairs(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Traces of both drivers of each requested pair side by side (columns ``*_a`` and ``*_b``)."""
    out = pairs.select(*PAIR)
    for side in ("a", "b"):
        renamed = traces.select(
            "session_key",
            F.col("driver_number").alias(f"driver_{side}"),
            *[F.col(c).alias(f"{c}_{side}") for c in traces.columns if c not in ("session_key", "driver_number")],
        )
        other = "driver_b" if side == "a" else "driver_a"
        out = out.join(renamed, ["session_key", f"driver_{side}"])
    return out


def time_delta(pairs: DataFrame) -> DataFrame:
    """Cumulative time difference per grid point; positive means A is ahead."""
    deltas = pairs.select(*PAIR, F.zip_with("cumtime_a", "cumtime_b", lambda a, b: b - a).alias("_d"))
    # The next point stands in the same array, so no point travels to find its neighbour.
    change = F.transform(
        "_d", lambda x, k: F.coalesce(F.signum(F.get(F.col("_d"), k + 1)) != F.signum(x), F.lit(False)))
    points = deltas.select(
        *PAIR, F.size("_d").alias("_n"),
        F.posexplode(F.arrays_zip(F.col("_d").alias("delta"), change.alias("lead_change"))).alias("k", "_p"),
    )
    delta = F.col("_p.delta")
    return points.select(
        *PAIR,
        "k",
        (F.col("k") * 100.0 / (F.col("_n") - 1)).alias("lap_pct"),
        delta.alias("delta"),
        F.when(delta >= 0, delta).otherwise(0.0).alias("ahead_a"),
        F.when(delta < 0, delta).otherwise(0.0).alias("ahead_b"),
        F.col("_p.lead_change").alias("lead_change"),
    )


def time_delta_summary(delta: DataFrame) -> DataFrame:
    """Lead changes, peak advantages (when above 0.05 s) and the final gap of each pair."""
    sums = delta.groupBy(*PAIR).agg(
        F.count_if("lead_change").alias("lead_changes"),
        F.max(F.struct("delta", -F.col("k"))).alias("_hi"),
        F.min(F.struct("delta", "k")).alias("_lo"),
        F.max_by("delta", "k").alias("final_gap"),
    )
    high, low = F.col("_hi.delta"), F.col("_lo.delta")
    verdict = (
        F.when(F.abs("final_gap") < 0.001, "dead heat").when(F.col("final_gap") > 0, "a").otherwise("b")
    )
    return sums.select(
        *PAIR,
        "lead_changes",
        F.when(high > 0.05, high).alias("peak_a"),
        F.when(high > 0.05, -F.col("_hi.col2")).alias("peak_a_k"),
        F.when(low < -0.05, low).alias("peak_b"),
        F.when(low < -0.05, F.col("_lo.k")).alias("peak_b_k"),
        "final_gap",
        verdict.alias("ahead_at_finish"),
    )


def _winners(points: int) -> Column:
    """The faster driver between neighbouring display points (ties go to A)."""
    faster = F.zip_with(
        upsample(F.col("speed_trace_a"), points), upsample(F.col("speed_trace_b"), points),
        lambda a, b: F.when(a >= b, "a").otherwise("b"),
    )
    return F.slice(faster, 1, points - 1)


def microsectors(pairs: DataFrame, points: int = DISPLAY_POINTS) -> DataFrame:
    """Faster driver on each gap between neighbouring display points (ties go to A)."""
    return pairs.select(*PAIR, F.posexplode(_winners(points)).alias("k", "winner"))


def microsector_runs(pairs: DataFrame, points: int = DISPLAY_POINTS) -> DataFrame:
    """Consecutive microsectors with one winner merged; neighbouring runs share a display point."""
    won = pairs.select(*PAIR, _winners(points).alias("_w"))
    new = F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1),
        lambda k: (k == 0) | (F.get(F.col("_w"), k - 1) != F.get(F.col("_w"), k)),
    )
    runs = F.transform(
        "_new",
        lambda k, i: F.struct(
            i.cast("long").alias("run"), F.get(F.col("_w"), k).alias("winner"), k.alias("first_point"),
            F.coalesce(F.get(F.col("_new"), i + 1), F.size("_w")).alias("last_point"),
        ),
    )
    return won.where(F.size("_w") > 0).withColumn("_new", new).select(*PAIR, F.inline(runs))
