"""Ordered computations per key that survive a hot key.

``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here every key is cut
into contiguous *buckets* of its ordering column. The buckets are summarised (a map-side combined
aggregate), a window over the small summary table hands each bucket what it needs from the others,
and the rows themselves are only ever windowed inside one bucket. The rows are shuffled once, on
``keys + bucket``, which serves both the join with the summary and the window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapspark.session import materialize

BUCKET = "_bucket"


def _with_context(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    partials: Sequence[Column],
    context: Callable[[WindowSpec, WindowSpec], Sequence[Column]],
) -> DataFrame:
    """Attach to every row values derived from the per-bucket summaries of its key."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    rows = present.withColumn(BUCKET, bucket)
    summary = rows.groupBy(*keys, BUCKET).agg(*partials)
    whole = Window.partitionBy(*keys)
    links = summary.select(*keys, BUCKET, *context(whole.orderBy(BUCKET), whole))
    return rows.join(links, [*keys, BUCKET])


def _inside(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(o).asc_nulls_last() for o in order])


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Running totals and last-non-null values per key, inclusive of the current row.

    With ``keep_bucket`` the rows keep ``_bucket``: an ordered operator that takes it as its bucket finds them dealt already.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    stamp = [F.col(o) for o in order]
    partials = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    partials += [
        F.max(F.when(c.isNotNull(), F.struct(*stamp, c.alias("_v")))).alias(f"_l_{n}")
        for n, c in lasts.items()
    ]

    def context(ordered: WindowSpec, _whole: WindowSpec) -> list[Column]:
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        out = [F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums]
        out += [
            F.last(F.col(f"_l_{n}"), ignorenulls=True).over(before)["_v"].alias(f"_c_{n}")
            for n in lasts
        ]
        return out

    rows = _with_context(df, keys, bucket, partials, context)
    so_far = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {}
    for n, c in sums.items():
        inner = F.sum(c).over(so_far)
        new[n] = F.when(F.col(f"_c_{n}").isNull(), inner).otherwise(
            F.col(f"_c_{n}") + F.coalesce(inner, F.lit(0))
        )
    for n, c in lasts.items():
        new[n] = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_c_{n}"))
    drop = [*([] if keep_bucket else [BUCKET]), *[f"_c_{n}" for n in [*sums, *lasts]]]
    return rows.withColumns(new).drop(*drop)


def row_number_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """1-based position of each row in its key; ``order`` must be a total order."""
    return with_running(df, keys, order, bucket, sums={name: F.lit(1).cast("long")})


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, bucket: Column, name: str
) -> DataFrame:
    """First ``n`` rows of each key with their 1-based place, for any ``n``; ``bucket`` ascends in ``order``.

    Counts per bucket tell which buckets hold the first ``n`` rows and how many rows lie before each; only those are put
    in order. Rows of a null key are a key of their own, as in a window.
    """
    rows = df.withColumn(BUCKET, bucket)
    sizes = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_base") < n)
    wanted = wanted.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, BUCKET)], "_base")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, BUCKET)]
    rows = rows.join(wanted, reduce(and_, same)).drop(*[f"_of_{c}" for c in (*keys, BUCKET)])
    place = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)) + F.col("_base")
    return rows.withColumn(name, place).where(F.col(name) <= n).drop(BUCKET, "_base")


def exploded_range(df: DataFrame, start: Column, stop: Column, name: str, piece: int = 4096) -> DataFrame:
    """A row for each integer from ``start`` to ``stop`` (none if it is smaller); no array holds more than ``piece``.

    Long ranges are first cut into pieces, in a list that is ``piece`` times shorter.
    """
    cut = df.withColumns({"_start": start.cast("long"), "_stop": stop.cast("long")}).where(F.col("_start") <= F.col("_stop"))
    cut = cut.withColumn("_start", F.explode(F.sequence("_start", "_stop", F.lit(piece).cast("long"))))
    end = F.least(F.col("_start") + (piece - 1), F.col("_stop"))
    return cut.withColumn(name, F.explode(F.sequence("_start", end))).drop("_start", "_stop")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    rows_name: str | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Values of the previous and next row, and of the first and last row of the key.

    ``rows_name`` adds the number of rows of the key, ``keep_bucket`` keeps ``_bucket``.
    ``_has_lag`` / ``_has_lead`` tell a missing neighbour from a neighbour holding null.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    first, last = dict(first or {}), dict(last or {})
    stamp = F.struct(*[F.col(o) for o in order])

    def pack(values: Mapping[str, Column]) -> Column:
        return F.struct(F.lit(True).alias("_here"), *[c.alias(n) for n, c in values.items()])

    head, tail = {**lead, **first}, {**lag, **last}
    partials = [
        F.min_by(pack(head), stamp).alias("_head"),
        F.max_by(pack(tail), stamp).alias("_tail"),
        F.count(F.lit(1)).alias("_size"),
    ]

    def context(ordered: WindowSpec, whole: WindowSpec) -> list[Column]:
        total = [F.sum("_size").over(whole).alias(rows_name)] if rows_name else []
        ends = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return [
            F.lag("_tail").over(ordered).alias("_prev"),
            F.lead("_head").over(ordered).alias("_next"),
            F.first("_head").over(ends).alias("_first"),
            F.last("_tail").over(ends).alias("_last"),
            *total,
        ]

    rows = _with_context(df, keys, bucket, partials, context)
    w = _inside(keys, order)
    rows = rows.withColumns(
        {
            "_prev": F.coalesce(F.lag(pack(tail)).over(w), F.col("_prev")),
            "_next": F.coalesce(F.lead(pack(head)).over(w), F.col("_next")),
        }
    )
    new = {n: F.col("_prev")[n] for n in lag}
    new |= {n: F.col("_next")[n] for n in lead}
    new |= {n: F.col("_first")[n] for n in first}
    new |= {n: F.col("_last")[n] for n in last}
    new["_has_lag"] = F.col("_prev").isNotNull()
    new["_has_lead"] = F.col("_next").isNotNull()
    return rows.withColumns(new).drop(*([] if keep_bucket else [BUCKET]), "_prev", "_next", "_first", "_last")


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    name: str,
    window: int,
    min_periods: int,
) -> DataFrame:
    """Mean over the last ``window`` rows of the key (the value must not be null)."""
    need = window - 1
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    rows = present.withColumn(BUCKET, bucket)
    inside = _inside(keys, order)
    backwards = Window.partitionBy(*keys, BUCKET).orderBy(*[F.col(o).desc_nulls_first() for o in order])
    # The last window-1 values of every bucket, newest first: never more than window-1 elements.
    tails = (
        rows.select(*keys, BUCKET, *order, value)
        .withColumn("_back", F.row_number().over(backwards))
        .where(F.col("_back") <= max(need, 1))
        .groupBy(*keys, BUCKET)
        .agg(F.sort_array(F.collect_list(F.struct("_back", value))).alias("_tail"))
    )
    # A non-empty bucket has at least one row, so window-1 earlier buckets always suffice.
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(-max(need, 1), -1)
    links = tails.select(
        *keys,
        BUCKET,
        F.slice(
            F.flatten(
                F.transform(
                    F.reverse(F.collect_list("_tail").over(earlier)),
                    lambda t: F.transform(t, lambda e: e[value]),
                )
            ),
            1,
            max(need, 1),
        ).alias("_carry"),
    )
    rows = rows.join(links, [*keys, BUCKET])
    recent = inside.rowsBetween(-need, Window.currentRow)
    have = F.count(F.lit(1)).over(recent).cast("int")
    borrowed = F.slice("_carry", 1, F.lit(window) - F.col("_have"))
    rows = rows.withColumns({"_have": have, "_sum": F.sum(value).over(recent)})
    rows = rows.withColumn("_borrow", borrowed)
    n = F.col("_have") + F.size("_borrow")
    mean = F.aggregate("_borrow", F.col("_sum"), lambda s, v: s + v) / n
    return rows.withColumn(name, F.when(n >= min_periods, mean)).drop(
        BUCKET, "_carry", "_have", "_sum", "_borrow"
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    values: Sequence[str],
    bucket: Callable[[str], Column],
) -> DataFrame:
    """Latest right row at or before each left row (inclusive), as one union and one running scan.

    Right rows sort before left rows at equal times; among right rows with equal times the largest
    ``values`` wins. Left rows without a match keep nulls.
    """
    extra = [c for c in left.columns if c not in by and c != on]
    tagged_left = left.select(
        *by, on, F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), F.lit(None).alias("_hit")
    )
    tagged_right = right.select(
        *by, on, F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_hit")
    )
    both = tagged_left.unionByName(tagged_right)
    out = with_running(both, by, [on, "_side", "_hit"], bucket(on), lasts={"_match": F.col("_hit")})
    return out.where(F.col("_side") == 1).select(*by, on, "_row.*", "_match.*")


def with_runs_merged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, number: str = "run"
) -> DataFrame:
    """Consecutive rows of a key with one value as a single row.

    Gives ``keys``, the run's 0-based ``number``, ``value``, ``first_*`` and ``last_*`` of every order column and
    ``length``. A null value is a value like any other; ``order`` must be a total order; rows without a key are left out.

    Runs are built inside the buckets first, so the rows are read and shuffled once. Of a bucket only the first value,
    the last value and the number of changes go over the whole key: they tell whether its first run goes on from the
    bucket before, and which number it has.
    """
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.select(*keys, *order, F.struct(F.col(value)).alias("_value"), bucket.alias(BUCKET))
    inside = _inside(keys, order)
    changed = ~F.lag("_value").over(inside).eqNullSafe(F.col("_value")) & (F.row_number().over(inside) > 1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_new", changed.cast("long")).withColumn("_part", F.sum("_new").over(so_far))

    def merged(parts: DataFrame, by: Sequence[str], first: Column, last: Column, length: Column) -> DataFrame:
        return parts.groupBy(*by).agg(
            F.first("_value").alias("_value"), F.min(first).alias("_from"), F.max(last).alias("_to"),
            F.sum(length).alias("length"),
        )

    stamp = F.struct(*order)
    parts = materialize(merged(rows, [*keys, BUCKET, "_part"], stamp, stamp, F.lit(1)))
    ends = parts.groupBy(*keys, BUCKET).agg(
        F.min_by("_value", "_part").alias("_head"), F.max_by("_value", "_part").alias("_tail"),
        F.max("_part").alias("_changes"),
    )
    buckets = Window.partitionBy(*keys).orderBy(BUCKET)
    goes_on = F.lag("_tail").over(buckets).eqNullSafe(F.col("_head"))
    ends = ends.withColumn("_starts", F.when(goes_on, 0).otherwise(1))
    upto = buckets.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.sum("_starts").over(upto) + F.sum("_changes").over(upto) - F.col("_changes") - 1
    numbered = parts.join(ends.select(*keys, BUCKET, base.alias("_base")), [*keys, BUCKET])
    numbered = numbered.withColumn(number, F.col("_base") + F.col("_part"))
    runs = merged(numbered, [*keys, number], F.col("_from"), F.col("_to"), F.col("length"))
    return runs.select(
        *keys, number, F.col("_value")[value].alias(value), *[F.col("_from")[o].alias(f"first_{o}") for o in order],
        *[F.col("_to")[o].alias(f"last_{o}") for o in order], "length",
    )
