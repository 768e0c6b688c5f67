"""Approximate quantiles from KLL sketches that can be stored and merged; ``quantiles`` has the exact operators.

A sketch holds a few thousand numbers at most, whatever the number of rows, so sketches of sessions, days or micro-batches
are kept and merged instead of the rows. Its estimates are random within a bound on the rank, not on the value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import nan_to_null

#: Size parameter of a sketch; the larger, the closer.
K = 400


def rank_error(k: int = K) -> float:
    """Share of the rows by which the rank of an estimate is off at most, in 99 of 100 cases (published fit for KLL)."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One ``sketch`` of ``value`` for each key, combined map-side; null and NaN do not count, keys without a value go."""
    if not 8 <= k <= 65535:
        raise ValueError(f"k must lie between 8 and 65535, got {k!r}")
    rows = df.select(*keys, nan_to_null(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of the same key as one."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Number of values and estimated quantiles (shares from 0 to 1, an array in their order) of each sketch."""
    if not quantiles or not all(0 <= q <= 1 for q in quantiles):
        raise ValueError(f"quantiles must be shares from 0 to 1, got {quantiles!r}")
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        F.kll_sketch_get_n_double("sketch").alias("n"),
        F.kll_sketch_get_quantile_double("sketch", wanted).alias("estimates"),
    )


def rank_deviation(df: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """How far each estimate's rank among the rows is from the wanted one: ``keys, quantile, n, deviation`` (a share).

    Equal values hold a range of ranks; an estimate inside it is off by nothing. The rows are read once and counted
    map-side.
    """
    v = nan_to_null(F.col(value).cast("double"))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v")).join(estimates.select(*keys, "estimates"), list(keys))
    counts = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(quantiles)):
        counts.append(F.count_if(F.col("_v") < F.col("estimates")[i]).alias(f"_below{i}"))
        counts.append(F.count_if(F.col("_v") <= F.col("estimates")[i]).alias(f"_upto{i}"))
    ranks = F.array(*[
        F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_below{i}").alias("below"), F.col(f"_upto{i}").alias("upto"))
        for i, q in enumerate(quantiles)
    ])
    out = rows.groupBy(*keys).agg(*counts).select(*keys, F.col("_n").alias("n"), F.inline(ranks))
    q = F.col("quantile")
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - q, q - F.col("upto") / F.col("n"))
    return out.select(*keys, "quantile", "n", off.alias("deviation"))
