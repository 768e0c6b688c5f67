"""Exact grouped quantiles and ranks without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapspark.functions.scalar import value_bucket
from lapspark.operators.ordered import with_running


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their frequency: combined map-side, spread over the values."""
    rows = df.where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key (mean of the two middle values for an even count).

    A histogram over value cells finds the one or two cells holding the middle ranks; only the
    distinct values inside those cells are then put in order.
    """
    counts = value_counts(df, keys, value).withColumn("_cell", value_bucket(value))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cell_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        *keys,
        "_cell",
        (F.sum("_cell_n").over(upto) - F.col("_cell_n")).alias("_base"),
        F.sum("_cell_n").over(upto).alias("_top"),
        F.floor((F.sum("_cell_n").over(whole) + 1) / 2).alias("_lo"),
        F.floor((F.sum("_cell_n").over(whole) + 2) / 2).alias("_hi"),
    )
    middle = cells.where(
        ((F.col("_lo") > F.col("_base")) & (F.col("_lo") <= F.col("_top")))
        | ((F.col("_hi") > F.col("_base")) & (F.col("_hi") <= F.col("_top")))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counts.join(middle, [*keys, "_cell"]).withColumn(
        "_end", F.col("_base") + F.sum("_n").over(inside)
    )
    begin = F.col("_end") - F.col("_n")

    def at(rank: str):
        return F.max(F.when((F.col(rank) > begin) & (F.col(rank) <= F.col("_end")), F.col(value)))

    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(name))


def value_percentile(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per distinct value: the percentage of the key's values that are less than or equal to it."""
    counts = value_counts(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = with_running(counts, keys, [value], value_bucket(value), sums={"_upto": F.col("_n")})
    return ranked.join(totals, list(keys)).select(
        *keys, value, (F.col("_upto") * 100.0 / F.col("_total")).alias(name)
    )
