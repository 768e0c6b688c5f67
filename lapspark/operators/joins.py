"""Join shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 5


def join_per_key(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with what was aggregated for each of ``keys``; one key may hold a large share of the rows.

    An aggregate is already dealt by its keys, and a join that reuses this cannot be split. With the keys' hash as one
    more join key both sides are dealt for the join itself: adaptive execution then broadcasts a small side by its
    measured size and splits the partitions of hot keys.
    """
    # Hashes depend on the type, so the statistics take that of the rows.
    theirs = F.xxhash64(*[F.col(k).cast(rows.schema[k].dataType) for k in keys])
    joined = rows.withColumn("_hash", F.xxhash64(*keys)).join(stats.withColumn("_hash", theirs), [*keys, "_hash"], how)
    return joined.drop("_hash")


def _levels(length: Column) -> Column:
    """Smallest level whose cell (32 ** (level + 1) units) is at least as long as the interval.

    Level 11 covers every 64-bit length.
    """
    level = F.lit(11)
    for k in range(10, -1, -1):
        level = F.when(length <= (1 << (CELL_BITS * (k + 1))), F.lit(k)).otherwise(level)
    return level


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), (level + 1) * CELL_BITS)).cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    point: str,
    start: str,
    end: str,
) -> DataFrame:
    """Points inside closed intervals of the same key, as an equi-join on (key, level, cell).

    Each interval picks the level whose cells are no shorter than itself, so it touches at most
    two cells whatever its length; a point probes one cell on each level its key really uses.
    Only pairs sharing a cell meet, which keeps a hot key spread over its cells.
    """
    bounded = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    bounded = bounded.withColumn("_level", _levels(F.col(end) - F.col(start)))
    placed = bounded.withColumn(
        "_cell",
        F.explode(F.sequence(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level")))),
    )
    used = bounded.groupBy(*by).agg(F.sort_array(F.collect_set("_level")).alias("_levels"))
    probes = join_per_key(points, used, by)
    probes = probes.withColumn("_level", F.explode("_levels")).withColumn(
        "_cell", _cell(F.col(point), F.col("_level"))
    )
    hit = probes.join(placed, [*by, "_level", "_cell"])
    return hit.where(F.col(point).between(F.col(start), F.col(end))).drop("_level", "_cell", "_levels")
