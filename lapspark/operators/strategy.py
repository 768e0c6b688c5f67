"""Undercuts, undercut windows and projected finishing orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import LAST_BUCKET, at_least, half_even, nan_to_null, sequence_bucket, value_bucket
from lapspark.operators.joins import CELL_BITS
from lapspark.operators.laps import (
    DRIVER,
    LAP,
    SESSION,
    clean_laps,
    gap_to_leader,
    last_laps,
    restrict_drivers,
    valid_laps,
)
from lapspark.operators.ordered import row_number_in_order, with_neighbours
from lapspark.operators.positions import position_on_lap, session_positions
from lapspark.operators.stints import laps_with_stints
from lapspark.schemas import DEGRADATION_FREE_LAPS, DEGRADATION_PER_LAP
from lapspark.session import materialize

#: Drivers of one course in a row, and drivers of the other side that meet them in one place.
PIECE, DEAL = 256, 4096


def pit_laps(stints: DataFrame) -> DataFrame:
    """Laps on which a driver starts any stint after the first.

    The first stint is taken out by comparing with a per-driver minimum, so no driver's stints are
    gathered for sorting.
    """
    ranked = stints.withColumn(
        "_order",
        F.struct(F.col("stint_number").isNull(), F.col("stint_number"), F.col("lap_start")),
    )
    groups = ranked.groupBy(*DRIVER, "_order").agg(F.count(F.lit(1)).alias("_n"))
    first = groups.groupBy(*DRIVER).agg(F.min("_order").alias("_first"))
    return (
        groups.join(first, DRIVER)
        .where((F.col("_order") != F.col("_first")) | (F.col("_n") > 1))
        .select(*DRIVER, F.col("_order.lap_start").alias("pit_lap"))
        .where(F.col("pit_lap").isNotNull())
        .distinct()
    )


def _digit(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level * CELL_BITS)).cast("long") % (1 << CELL_BITS)


def _prefix(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), (level + 1) * CELL_BITS)).cast("long")


def _cells(df: DataFrame, low_dim: int) -> DataFrame:
    """Replicate a row once per (level, level) at which it could be the lower or higher partner."""
    out = df
    for dim, value in ((1, "_v1"), (2, "_v2")):
        level = f"_l{dim}"
        out = out.withColumn(level, F.explode(F.sequence(F.lit(0), F.col("_levels") - 1)))
        out = out.withColumns(
            {f"_p{dim}": _prefix(F.col(value), F.col(level)), f"_d{dim}": _digit(F.col(value), F.col(level))}
        )
        if dim != low_dim:
            out = out.where(F.col(f"_d{dim}") > 0)
    return out


def detect_undercuts(
    laps: DataFrame, stints: DataFrame, position: DataFrame, lookahead: int = 3, drivers: Sequence | None = None,
    gaps: DataFrame | None = None,
) -> DataFrame:
    """Position swaps around pit stops, among ``drivers`` if given (an event depends on its two drivers only).

    Driver A pits; driver B does not pit on that lap. A was behind and gets ahead within
    ``lookahead`` laps: undercut by A. A was not behind and is then not ahead: overcut by B.
    Null positions never qualify. Before/after positions are compared digit by digit (base 32):
    two rows meet only where the digits above the compared one agree, in both dimensions at once,
    so the pairs examined follow the number of swaps and not the square of the field. Drivers with the
    same positions before and after a stop share a course; courses are compared, and their drivers
    are paired in the end only. With ``gaps`` (``gap`` by lap and driver) an event has its attacker's ``gap``, which comes to
    the drivers before they are paired: events grow with the square of the field and are not shuffled for it.
    """
    at_least(1, lookahead=lookahead)
    stints = restrict_drivers(stints, drivers)
    pits = pit_laps(stints)
    runners = stints.select(*DRIVER).distinct()
    offsets = [-1, *range(1, lookahead + 1)]
    wanted = (
        pits.select("session_key", "pit_lap")
        .distinct()
        .withColumn("_off", F.explode(F.array(*[F.lit(o) for o in offsets])))
        .withColumn("lap_number", F.col("pit_lap") + F.col("_off"))
        .groupBy("session_key", "lap_number")
        .agg(F.collect_list(F.struct("pit_lap", "_off")).alias("_wanted"))
    )
    around = session_positions(wanted, position.join(runners, DRIVER, "left_semi"), laps)
    around = around.select(*DRIVER, F.col("position").cast("long"), F.inline("_wanted"))
    at = [F.max(F.when(F.col("_off") == o, F.col("position"))) for o in offsets]
    seen = materialize(
        around.groupBy(*DRIVER, "pit_lap")
        .agg(at[0].alias("before"), F.array(*at[1:]).alias("after"))
        .where(F.col("before").isNotNull())
    )
    top = seen.groupBy(*SESSION).agg(
        F.max(F.greatest(F.col("before"), F.array_max("after"))).alias("_top")
    )
    digits = F.greatest(F.ceil(F.log2(F.col("_top") + 2.0) / CELL_BITS), F.lit(1)).cast("int")
    marked = seen.join(pits.withColumn("_pits", F.lit(True)), [*DRIVER, "pit_lap"], "left")
    numbers = F.transform("after", lambda p: F.coalesce(p.cast("string"), F.lit("-")))
    more = []
    if gaps is not None:
        more = ["gap"]
        marked = marked.join(gaps.select(*DRIVER, F.col("lap_number").alias("pit_lap"), *more), [*DRIVER, "pit_lap"], "left")
    marked = materialize(marked.where(F.col("driver_number").isNotNull()).select(
        *DRIVER, "pit_lap", *more, "before", "after", F.col("_pits").isNotNull().alias("_stopped"),
        F.concat_ws(",", F.col("before").cast("string"), numbers).alias("_course")))
    course = ["session_key", "pit_lap", "_stopped", "_course"]
    courses = marked.groupBy(*course).agg(
        F.first("before").alias("before"), F.first("after").alias("after"), F.count(F.lit(1)).alias("_n"))
    courses = materialize(courses)

    def side(stopped: bool, kind: str, before: Column, after) -> DataFrame:
        rows = courses.where(F.col("_stopped") == stopped).join(top.select("session_key", digits.alias("_levels")), SESSION)
        later = F.posexplode("after").alias("_o", "_after")
        out = rows.select("session_key", "_course", "_n", "pit_lap", "before", "after", "_levels", later)
        out = out.where(F.col("_after").isNotNull())
        return out.withColumns({"_kind": F.lit(kind), "_v1": before, "_v2": after(F.col("_after"))})

    own = F.col("before")
    # undercut: before(B) < before(A) and after(A) < after(B)
    # overcut:  before(A) < before(B) + 1 and after(B) < after(A) + 1
    a = _cells(side(True, "undercut", own, lambda v: v), low_dim=2).unionByName(
        _cells(side(True, "overcut", own, lambda v: v + 1), low_dim=1)
    )
    b = _cells(side(False, "undercut", own, lambda v: v), low_dim=1).unionByName(
        _cells(side(False, "overcut", own + 1, lambda v: v), low_dim=2)
    )
    meet = ["session_key", "pit_lap", "_kind", "_o", "_l1", "_p1", "_l2", "_p2"]
    b = b.select(
        *meet,
        F.col("_course").alias("_b_course"),
        F.col("after").alias("_b_after"),
        F.col("_d1").alias("_b1"),
        F.col("_d2").alias("_b2"),
    )
    undercut = F.col("_kind") == "undercut"
    swap = F.when(
        undercut, (F.col("_b1") < F.col("_d1")) & (F.col("_d2") < F.col("_b2"))
    ).otherwise((F.col("_d1") < F.col("_b1")) & (F.col("_b2") < F.col("_d2")))
    pair = F.arrays_zip(F.col("after").alias("a"), F.col("_b_after").alias("b"))
    sooner = F.exists(
        F.slice(pair, F.lit(1), F.col("_o")),
        lambda z: F.coalesce(F.when(undercut, z["a"] < z["b"]).otherwise(z["a"] >= z["b"]), F.lit(False)),
    )
    swaps = a.join(b, meet).where(swap & ~sooner).select("session_key", "pit_lap", "_kind", "_course", "_b_course", "_n")
    events = _drivers_of(materialize(swaps), marked)

    def of(first: str, second: str, c: str) -> Column:
        told = [F.col(f"{side}.{c}") if more else F.col(side) for side in (first, second)]
        return F.when(undercut, told[0]).otherwise(told[1])

    return events.select(
        "session_key",
        F.col("pit_lap").alias("lap"),
        of("_a", "_b", "driver_number").alias("attacking_driver"),
        of("_b", "_a", "driver_number").alias("defending_driver"),
        F.col("_kind").alias("type"),
        *[of("_a", "_b", c).alias(c) for c in more],
    )


def _drivers_of(swaps: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs of courses as the pairs ``_a``, ``_b`` of their drivers (with the ``gap`` of each, if they have one), dealt so that no task gets the whole of a course.

    The drivers of a course come in pieces of about ``PIECE``. Each piece on the staying side is copied to as many
    places as ``DEAL`` drivers of the stopping side ask for, so one place gives at most some ``PIECE * DEAL`` events.
    """
    course = ["session_key", "pit_lap", "_course"]
    sizes = marked.groupBy(*course, "_stopped").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("_pieces"))
    piece = F.pmod(F.xxhash64("driver_number"), F.col("_pieces")).alias("_piece")
    driver = F.struct("driver_number", "gap") if "gap" in marked.columns else F.col("driver_number")
    pieces = marked.join(sizes, [*course, "_stopped"]).select(*course, "_stopped", driver.alias("_driver"), piece)
    pieces = pieces.groupBy(*course, "_stopped", "_piece").agg(F.collect_list("_driver").alias("_drivers"))
    theirs = pieces.where(~F.col("_stopped")).select(
        "session_key", "pit_lap", F.col("_course").alias("_b_course"), F.col("_drivers").alias("_bs"))
    other = ["session_key", "pit_lap", "_b_course"]
    load = swaps.groupBy(*other).agg(F.ceil(F.sum("_n") / DEAL).alias("_deals"))
    place = F.pmod(F.xxhash64("_course", "_kind", "_piece"), F.col("_deals")).alias("_deal")
    left = swaps.join(pieces.where("_stopped"), course).join(load, other).select(*other, "_kind", "_drivers", place)
    right = theirs.join(load, other).select(*other, "_bs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)).alias("_deal"))
    # A few bytes here stand for many events: the number of tasks is fixed, not merged by size.
    tasks = int(swaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*other, "_deal"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_hash"), keys)
    return met.select("session_key", "pit_lap", "_kind", "_bs", F.explode("_drivers").alias("_a")).select(
        "session_key", "pit_lap", "_kind", "_a", F.explode("_bs").alias("_b"))


def undercut_markers(events: DataFrame, laps: DataFrame) -> DataFrame:
    """Events with the attacker's gap to the leader on that lap (0.0 when unknown).

    Many events should bring their ``gap`` along (``detect_undercuts(gaps=…)``): here all of them are shuffled to get it.
    """
    if "gap" in events.columns:
        return events.select(*[c for c in events.columns if c != "gap"], F.coalesce("gap", F.lit(0.0)).alias("gap"))
    gaps = gap_to_leader(laps).select(
        "session_key",
        F.col("driver_number").alias("attacking_driver"),
        F.col("lap_number").alias("lap"),
        "gap",
    )
    keys = ["session_key", "attacking_driver", "lap"]
    return events.join(gaps, keys, "left").withColumn(
        "gap", F.coalesce("gap", F.lit(0.0))
    )


def undercut_windows(laps: DataFrame, stints: DataFrame, threshold_seconds: float = 1.5) -> DataFrame:
    """Laps where the next-faster car is within reach and on older tyres."""
    rows = laps_with_stints(laps.where(nan_to_null(F.col("lap_duration")).isNotNull()), stints)
    rows = rows.withColumn("tyre_age", F.coalesce("tyre_age", F.lit(0)))
    paired = with_neighbours(
        rows,
        ["session_key", "lap_number"],
        ["lap_duration", "driver_number", "stint_number"],
        value_bucket("lap_duration"),
        lag={
            "target_driver": F.col("driver_number"),
            "_ahead": F.col("lap_duration"),
            "_ahead_age": F.col("tyre_age"),
        },
    )
    return paired.select(
        *LAP,
        "target_driver",
        (F.col("lap_duration") - F.col("_ahead")).alias("pace_delta"),
        (F.col("_ahead_age") - F.col("tyre_age")).alias("tyre_age_delta"),
    ).where((F.abs("pace_delta") <= threshold_seconds) & (F.col("tyre_age_delta") > 0))


def _triangle(n: Column) -> Column:
    return n * (n + 1) / 2


def project_finish(
    laps: DataFrame,
    stints: DataFrame,
    position: DataFrame,
    laps_remaining: int = 10,
    window: int = 5,
    with_gap: bool = False,
) -> DataFrame:
    """Projected finishing order from recent clean pace and tyre wear; retired cars go last.

    The wear beyond the free laps is summed in closed form instead of lap by lap. Totals are rounded
    to milliseconds before ranking; ties keep ascending driver numbers.
    """
    at_least(0, laps_remaining=laps_remaining)
    at_least(1, window=window)
    running = valid_laps(laps).where(F.col("driver_number").isNotNull())
    totals = running.groupBy(*DRIVER).agg(
        F.sum("lap_duration").alias("elapsed"), F.max("lap_number").alias("current_lap")
    )
    session_last = totals.groupBy(*SESSION).agg(F.max("current_lap").alias("_session_last"))
    totals = totals.join(session_last, SESSION)
    recent = last_laps(clean_laps(laps), window, "_r")
    pace = recent.groupBy(*DRIVER).agg(F.avg("lap_duration").alias("_pace"))
    cutoffs = totals.select(*DRIVER, "current_lap")
    tyres = (
        stints.join(cutoffs, DRIVER)
        .where(F.col("current_lap").between(F.col("lap_start"), F.col("lap_end")))
        .withColumn(
            "_age", F.col("current_lap") - F.col("lap_start") + F.coalesce("tyre_age_at_start", F.lit(0))
        )
        .groupBy(*DRIVER)
        .agg(F.max_by("_age", F.struct("stint_number", "lap_start")).alias("_age"))
    )
    places = position_on_lap(cutoffs, position, laps, "current_lap")
    rows = totals.join(pace, DRIVER, "left").join(tyres, DRIVER, "left").join(places, DRIVER, "left")

    age = F.coalesce("_age", F.lit(0)).cast("double")
    worn = F.greatest(age + laps_remaining - DEGRADATION_FREE_LAPS, F.lit(0.0))
    before = F.greatest(age - DEGRADATION_FREE_LAPS, F.lit(0.0))
    base = F.coalesce("_pace", F.lit(float("inf")))
    remaining = (
        base * laps_remaining + DEGRADATION_PER_LAP * (_triangle(worn) - _triangle(before))
        if laps_remaining
        else F.lit(0.0)
    )
    dnf = F.col("current_lap") < F.greatest(F.lit(1), F.col("_session_last") - 2)
    rows = rows.select(
        *DRIVER,
        F.when(dnf, F.lit(float("inf")))
        .otherwise(half_even(F.col("elapsed") + remaining, 3))
        .alias("projected_total_time"),
        F.nullif("current_position", F.lit(0)).alias("current_position"),
        F.when(dnf, "DNF").otherwise("running").alias("status"),
        dnf.alias("_dnf"),
    )
    rows = materialize(rows)
    # Infinite totals are all equal: they are cut by the tie-breaking driver number instead.
    endless = F.lit(LAST_BUCKET // 2) * F.when(F.col("_dnf"), 2).otherwise(1)
    bucket = F.when(
        F.col("projected_total_time") == float("inf"), endless + sequence_bucket("driver_number")
    ).otherwise(value_bucket("projected_total_time"))
    ranked = row_number_in_order(
        rows, SESSION, ["_dnf", "projected_total_time", "driver_number"], bucket, "projected_position"
    )
    ranked = ranked.withColumn(
        "position_change",
        F.when(~F.col("_dnf"), F.col("current_position") - F.col("projected_position")),
    )
    if not with_gap:
        return ranked.drop("_dnf")
    winner = ranked.where(~F.col("_dnf")).groupBy(*SESSION).agg(
        F.min("projected_total_time").alias("_winner")
    )
    gap = F.when(F.col("_dnf"), F.lit(0.0)).otherwise(F.col("projected_total_time") - F.col("_winner"))
    change = F.when(F.col("_dnf"), F.lit("DNF")).otherwise(
        F.concat(
            F.lit("P"), F.coalesce(F.col("current_position").cast("string"), F.lit("?")),
            F.lit(" → P"), F.col("projected_position").cast("string"),
        )
    )
    return ranked.join(winner, SESSION, "left").withColumns(
        {"gap_to_winner": gap, "change_label": change}
    ).drop("_winner", "_dnf")


def project_finish_simple(laps: DataFrame, total_laps: int, recent_window: int = 5) -> DataFrame:
    """Elapsed time plus the remaining laps at the mean of the last few valid laps."""
    at_least(0, total_laps=total_laps)
    at_least(1, recent_window=recent_window)
    valid = valid_laps(laps).where(F.col("driver_number").isNotNull())
    totals = valid.groupBy(*DRIVER).agg(
        F.sum("lap_duration").alias("_elapsed"), F.max("lap_number").alias("laps_completed")
    )
    recent = (
        last_laps(valid, recent_window, "_r")
        .groupBy(*DRIVER)
        .agg(F.avg("lap_duration").alias("recent_pace"))
    )
    left = F.greatest(F.lit(total_laps) - F.col("laps_completed"), F.lit(0))
    rows = totals.join(recent, DRIVER).select(
        *DRIVER,
        "laps_completed",
        half_even(F.col("recent_pace"), 3).alias("recent_pace"),
        half_even(F.col("recent_pace") * left, 3).alias("projected_remaining"),
        half_even(F.col("_elapsed") + F.col("recent_pace") * left, 3).alias("projected_total"),
    )
    return row_number_in_order(
        materialize(rows), SESSION, ["projected_total", "driver_number"], value_bucket("projected_total"), "projected_position"
    )
