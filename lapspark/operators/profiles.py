"""Driver profiles, archetypes, percentile ranks and nearest-profile search."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapspark.functions.scalar import at_least, computed_once, dot, half_even, nan_to_null, unit
from lapspark.operators.laps import DRIVER, SESSION, top_per_key
from lapspark.operators.quantiles import value_percentile
from lapspark.schemas import BASE_FEATURES, STYLE_FEATURES, STYLE_PROFILES
from lapspark.session import materialize

PROFILE_BLOCK = 2048
#: Smaller blocks would cost more in centres than they can save.
SMALLEST_BLOCK = 64
#: Rounding of an angle near zero, in radians.
ANGLE_SLACK = 1e-7
#: Width of the rings around a pivot, in radians.
RING = 0.25


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: nan_to_null(F.col(f).cast("double")) for f in features})


def driver_profile(
    laps: DataFrame, means: Sequence[str] = STYLE_FEATURES, spreads: Sequence[str] = BASE_FEATURES
) -> DataFrame:
    """Per-driver feature means and population deviations."""
    rows = _clean(laps, list(dict.fromkeys([*means, *spreads])))
    return rows.groupBy(*DRIVER).agg(
        *[F.avg(f).alias(f) for f in means], *[F.stddev_pop(f).alias(f"{f}_std") for f in spreads]
    )


def _bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.groupBy(*SESSION).agg(
        *[F.min(f).alias(f"_lo_{f}") for f in features], *[F.max(f).alias(f"_hi_{f}") for f in features]
    )


def normalised_profile(laps: DataFrame, features: Sequence[str] = STYLE_FEATURES) -> DataFrame:
    """Min-max scaling over all laps of the session, then the mean per driver.

    The scaling is linear, so per-driver means are scaled instead of every lap: the lap table is
    aggregated once per driver and once per session and never joined.
    """
    rows = _clean(laps, features)
    means = rows.groupBy(*DRIVER).agg(*[F.avg(f).alias(f) for f in features])
    scaled = means.join(_bounds(rows, features), SESSION)

    def scale(f: str) -> Column:
        width = F.col(f"_hi_{f}") - F.col(f"_lo_{f}")
        return ((F.col(f) - F.col(f"_lo_{f}")) / F.when(width == 0, 1.0).otherwise(width)).alias(f)

    return scaled.select(*DRIVER, *[scale(f) for f in features])


def consistency_matrix(
    laps: DataFrame, features: Sequence[str] = BASE_FEATURES, drivers: Sequence | None = None
) -> DataFrame:
    """Population deviation per driver, scaled to 0-1 across the selected drivers."""
    rows = laps if drivers is None else laps.where(F.col("driver_number").isin(list(drivers)))
    spread = _clean(rows, features).groupBy(*DRIVER).agg(*[F.stddev_pop(f).alias(f) for f in features])
    scaled = spread.join(_bounds(spread, features), SESSION)
    return scaled.select(
        *DRIVER,
        *[
            (
                (F.col(f) - F.col(f"_lo_{f}")) / (F.col(f"_hi_{f}") - F.col(f"_lo_{f}") + 1e-9)
            ).alias(f)
            for f in features
        ],
    )


def archetype(profile: DataFrame) -> DataFrame:
    """Driving-style label: the first matching rule wins; a missing column counts as 0."""

    def v(name: str) -> Column:
        return nan_to_null(F.col(name).cast("double")) if name in profile.columns else F.lit(0.0)

    # Rule thresholds and labels.
    rules = [
        ((v("brake_events") > 0.65) & (v("brake_mean") > 0.60), "Aggressive Braker"),
        ((v("trail_brake_score") > 0.55) & (v("steer_std") > 0.60), "Trail Braking Specialist"),
        ((v("mean_speed") > 0.70) & (v("coasting_pct") < 0.35), "High Entry Speed"),
        ((v("throttle_pickup_pct") > 0.60) & (v("throttle_std") < 0.40), "Smooth Operator"),
        ((v("gear_changes") > 0.65) & (v("steer_std") > 0.55), "Technical Driver"),
    ]
    label = F.lit("Balanced Driver")
    for test, name in reversed(rules):
        label = F.when(test, name).otherwise(label)
    return profile.withColumn("archetype", label)


def tier(value: Column) -> Column:
    return (
        F.when(value >= 9, "Elite")
        .when(value >= 7, "Strong")
        .when(value >= 5, "Good")
        .when(value >= 3, "Average")
        .otherwise("Below Average")
    )


def rating_tier(reports: DataFrame) -> DataFrame:
    """Overall rating (mean of three, one decimal) with its tier."""
    mean = (F.col("race_craft_rating") + F.col("raw_pace_rating") + F.col("consistency_rating")) / 3
    return reports.withColumn("overall_rating", half_even(mean, 1)).withColumn(
        "overall_tier", tier(half_even(F.col("overall_rating"), 0))
    )


def percentile_rank(laps: DataFrame, features: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """Percentage of the session's laps at or below each lap's value, per feature (long form)."""
    rows = _clean(laps, features)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    long = rows.select(*SESSION, *ident, F.inline(pairs)).where(F.col("value").isNotNull())
    keys = [*SESSION, "feature"]
    ranks = value_percentile(long, keys, "value", "percentile")
    return long.join(ranks, [*keys, "value"])


def style_profiles(spark: SparkSession) -> DataFrame:
    """The built-in table of ten style profiles."""
    return spark.createDataFrame(STYLE_PROFILES, "name string, era string, vector array<double>")


def _unit_vector() -> Column:
    return unit(F.transform("vector", lambda x: x.cast("double")))


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _in_packs(rows: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """Rows packed into ``count`` arrays by a hash of ``key``."""
    pack = F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("_pack")
    return rows.groupBy(pack).agg(F.collect_list(F.struct(*rows.columns)).alias(name))


def profile_blocks(profiles: DataFrame, block: int = PROFILE_BLOCK) -> DataFrame:
    """``_block, _centre, _radius, _profiles``: profiles near one another in blocks of about ``block`` or fewer.

    Pivots are distinct profile vectors, chosen by a hash, two for each block to come. A profile belongs to the pivot at
    the smallest angle, there to a ring of angles (so a profile far from all pivots widens no block of near ones); what is
    more than ``block`` in a ring (copies of one profile, say) is cut. The radius is the largest angle between a block's
    mean direction and its profiles.
    """
    told = ["name", *[c for c in ("era",) if c in profiles.columns]]
    rows = materialize(profiles.select(*told, _unit_vector().alias("v"), F.monotonically_increasing_id().alias("_row")))
    n = rows.count()
    size = min(block, max(SMALLEST_BLOCK, math.isqrt(n)))
    count = 2 * max(1, -(-n // size))
    packs = -(-count // PROFILE_BLOCK)
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count)
    pivots = _in_packs(chosen.select(F.xxhash64("v").alias("pivot"), "v"), "pivot", packs, "_pivots")
    near = F.array_max(F.transform("_pivots", lambda p: F.struct(dot(F.col("v"), p["v"]).alias("cos"), p["pivot"].alias("pivot"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("_pack")
    best = rows.select("_row", "v", every).join(pivots, "_pack").groupBy("_row").agg(F.max(near).alias("_near"))
    ring = F.floor(_angle(F.col("_near.cos")) / RING)
    placed = materialize(rows.join(best.select("_row", F.concat_ws("/", "_near.pivot", ring).alias("_place")), "_row"))
    sizes = placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_n") / size))
    placed = placed.join(sizes, "_place").withColumn("_block", F.concat_ws("/", "_place", part))
    packed = placed.groupBy("_block").agg(F.collect_list(F.struct(*told, "v")).alias("_profiles"))
    zero = F.transform(F.col("_profiles")[0]["v"], lambda x: F.lit(0.0))
    total = F.aggregate("_profiles", zero, lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y))
    centred = packed.withColumn("_centre", unit(total))
    widest = F.array_min(F.transform("_profiles", lambda p: dot(F.col("_centre"), p["v"])))
    return centred.withColumn("_radius", _angle(widest))


def _hits(told: list[str], k: int) -> Column:
    """The ``k`` best profiles of a row's block for its query."""
    hit = lambda p: F.struct((-dot(F.col("_q"), p["v"])).alias("minus"), *[p[c].alias(c) for c in told])
    return F.slice(F.array_sort(F.transform("_profiles", hit)), 1, k).alias("_hits")


def bounded_hits(asked: DataFrame, blocks: DataFrame, told: list[str], k: int, ident: str) -> tuple[DataFrame, DataFrame]:
    """Blocks met by each query (``ident, _q``) with the ``k`` best of each as ``_hits``: first its nearest ones, then others.

    The similarity to any profile of a block is at most the cosine of the angle to its centre less its radius. Blocks whose
    bound is below the ``k``-th similarity found in the first block cannot hold a hit and are left out.
    """
    held = materialize(blocks)
    centres = held.select("_block", "_centre", "_radius")
    packs = max(1, -(-centres.count() // PROFILE_BLOCK))
    gathered = _in_packs(centres, "_block", packs, "_centres")
    rows = asked.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(gathered, "_pack")

    def bound(c: Column) -> Column:
        inside = F.greatest(F.lit(0.0), _angle(dot(F.col("_q"), c["_centre"])) - c["_radius"] - F.lit(ANGLE_SLACK))
        return F.struct(F.cos(inside).alias("upto"), c["_block"].alias("block"))

    rows = rows.select(ident, "_q", F.transform("_centres", bound).alias("_bounds"))
    rows = rows.withColumn("_block", F.array_max("_bounds")["block"])
    best = _hits(told, k)
    first = materialize(rows.join(held.select("_block", "_profiles"), "_block").select(
        ident, "_q", "_bounds", "_block", best, F.size("_profiles").alias("_scored")))
    found = F.when(F.size("_hits") >= k, -F.element_at("_hits", -1)["minus"])
    kth = F.nanvl(F.coalesce(found, F.lit(-2.0)), F.lit(-2.0))
    open_blocks = computed_once(kth, lambda least: F.filter(
        "_bounds", lambda b: (b["block"] != F.col("_block")) & (b["upto"] >= least)))
    rest = first.select(ident, "_q", F.explode(F.transform(open_blocks, lambda b: b["block"])).alias("_block"))
    rest = rest.join(held.select("_block", "_profiles"), "_block")
    return first.select(ident, "_hits", "_scored"), rest.select(ident, best, F.size("_profiles").alias("_scored"))


def cosine_topk(
    queries: DataFrame,
    profiles: DataFrame,
    k: int = 2,
    ident: str = "query_id",
    block: int = PROFILE_BLOCK,
) -> DataFrame:
    """The ``k`` most similar profiles of every query vector (ties by name).

    Profiles lie in blocks of neighbours (``profile_blocks``); a query meets whole blocks and keeps ``k`` hits of each, so
    no query-profile pair is ever emitted as a row, and blocks that cannot hold a hit are not met (``bounded_hits``).
    Vectors are divided by their length before they meet, so a pair costs one dot product. A profile's ``era``, where the
    table has one, is returned. An empty table of profiles gives no rows. Null vectors take no part.
    """
    at_least(1, k=k, block=block)
    told = ["name", *[c for c in ("era",) if c in profiles.columns]]
    profiles = profiles.where(F.col("vector").isNotNull())
    asked = queries.where(F.col("vector").isNotNull()).select(ident, _unit_vector().alias("_q"))
    if profiles.count() <= min(block, SMALLEST_BLOCK):
        whole = _in_packs(profiles.select(*told, _unit_vector().alias("v")), "name", 1, "_profiles")
        # One row of at most SMALLEST_BLOCK profiles goes to every task; a literal key would make this a cross join.
        only = F.pmod(F.xxhash64(ident), F.lit(1)).cast("int")
        met = asked.withColumn("_pack", only).join(F.broadcast(whole), "_pack").select(ident, _hits(told, k))
    else:
        first, rest = bounded_hits(asked, profile_blocks(profiles, block), told, k, ident)
        met = first.unionByName(rest)
    hits = met.select(ident, F.inline("_hits"))
    top = top_per_key(hits, [ident], [F.col("minus"), F.col("name")], k, "rank")
    return top.select(ident, "rank", *told, (-F.col("minus")).alias("similarity"))


def retrieval_quality(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search the profile table with its own vectors: per-profile ranks, then the overall rates."""
    found = cosine_topk(profiles.withColumnRenamed("name", "query_id"), profiles, 2)

    def at(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    each = found.groupBy(F.col("query_id").alias("profile")).agg(
        at(1, "name").alias("rank1_match"),
        at(1, "similarity").alias("rank1_similarity"),
        at(2, "name").alias("rank2_match"),
        at(2, "similarity").alias("rank2_similarity"),
    )
    each = each.withColumns(
        {
            "self_match": F.col("rank1_match") == F.col("profile"),
            "retrieval_margin": F.col("rank1_similarity") - F.col("rank2_similarity"),
        }
    )
    overall = each.agg(
        F.count(F.lit(1)).alias("n_profiles"),
        F.avg(F.col("self_match").cast("double")).alias("self_match_rate"),
        F.avg("retrieval_margin").alias("mean_retrieval_margin"),
    )
    return each, overall
