"""Column helpers shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sorts after every real bucket; used where the ordering value is null or infinite.
LAST_BUCKET = 1 << 62

LAP_BUCKET_BITS = 16
TIME_BUCKET_SECONDS = 300
VALUE_BUCKETS_PER_E = 65536


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a time zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def nan_to_null(c: Column | str) -> Column:
    """Spark ranks NaN above every number, so NaN must become null before any comparison."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def at_least(lowest: int, **arguments: int) -> None:
    """Raise for an argument that is no integer or too small; nothing is silently changed."""
    for name, value in arguments.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < lowest:
            raise ValueError(f"{name} must be an integer of at least {lowest}, got {value!r}")


def sequence_bucket(c: Column | str, descending: bool = False, bits: int | None = None) -> Column:
    """Contiguous chunk of an integer ordering column (lap number, sample number); null comes last either way.

    ``bits`` widens the chunks for a column of which one key holds few values.
    """
    chunk = F.shiftright(col(c).cast("long"), LAP_BUCKET_BITS if bits is None else bits)
    return F.coalesce(-chunk if descending else chunk, F.lit(LAST_BUCKET))


def time_bucket(c: Column | str, seconds: int = TIME_BUCKET_SECONDS) -> Column:
    """Contiguous chunk of a timestamp ordering column."""
    return F.coalesce(F.floor(micros(col(c)) / (seconds * 1_000_000)), F.lit(LAST_BUCKET))


def value_bucket(c: Column | str) -> Column:
    """Contiguous chunk of a numeric ordering column of unknown scale (logarithmic cells)."""
    x = col(c).cast("double")
    cell = F.floor(F.log1p(F.abs(x)) * VALUE_BUCKETS_PER_E)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(LAST_BUCKET))
        .when(F.abs(x) == float("inf"), F.signum(x).cast("long") * (LAST_BUCKET - 1))
        .otherwise(F.when(x < 0, -cell).otherwise(cell))
    )


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1_000_000.0


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(micros(ts) + F.round(seconds * 1_000_000).cast("long"))


def half_even(c: Column, digits: int) -> Column:
    """Round half to even on doubles; infinities pass through unchanged."""
    return F.when(F.abs(c) == float("inf"), c).otherwise(F.bround(c, digits))


def array_lerp(arr: Column, position: Column) -> Column:
    """Linear interpolation inside an array at a fractional 0-based position."""
    lo = F.least(F.floor(position), F.size(arr).cast("long") - 1).cast("int")
    hi = F.least(lo + 1, F.size(arr) - 1)
    a, b = F.get(arr, lo), F.get(arr, hi)
    return (b - a) * (position - lo) + a


def upsample(arr: Column, points: int) -> Column:
    """Stretch an array of any length onto ``points`` evenly spaced positions."""
    scale = (F.size(arr) - 1) / F.lit(float(points - 1))
    return F.when(
        F.size(arr) > 0,
        F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: array_lerp(arr, k * scale)),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, also where a lambda inside ``use`` refers to it."""
    return F.transform(F.array(value), use).getItem(0)


def unit(a: Column) -> Column:
    """The vector divided by its length; an (almost) zero vector becomes zero, so its cosines are 0.0."""

    def scaled(v: Column, length: Column) -> Column:
        return F.transform(v, lambda x: F.when(length < 1e-9, F.lit(0.0)).otherwise(x / length))

    return computed_once(a, lambda v: computed_once(F.sqrt(dot(v, v)), lambda length: scaled(v, length)))


def fraction_of_points(arr: Column, predicate) -> Column:
    """Share of array points satisfying a predicate; null points count in the denominator only."""
    return F.when(F.size(arr) > 0, F.size(F.filter(arr, predicate)) / F.size(arr))
