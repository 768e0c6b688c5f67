"""Ingest of JSON lines in one pass: good rows flow on, rejected lines are kept with their reason, both are counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapspark.sources.tables import without_nan

BAD_LINE = "bad line"
_BROKEN = "_broken"


def reasons(schema: T.StructType, required: Sequence[str]) -> list[str]:
    """All reasons for a rejection, in the order in which the first that holds is given."""
    stamps = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    return [BAD_LINE, *[f"missing {c}" for c in required], *[f"bad time {c}" for c in stamps]]


def checked_lines(lines: DataFrame, schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """Lines (column ``value``) as rows of the schema with ``reason`` (null: good) and the ``line`` where rejected.

    A line that is no JSON object or has a value of another type is bad as a whole; required fields must be there and not
    null; a time that is there must be readable. Blank lines are left out. NaN becomes null.
    """
    unknown = sorted(set(required) - set(schema.names))
    if unknown:
        raise ValueError(f"required fields {unknown} are not in the schema")
    stamps = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    text = [T.StructField(f.name, T.StringType() if f.name in stamps else f.dataType) for f in schema.fields]
    shape = T.StructType([*text, T.StructField(_BROKEN, T.StringType())])
    parsed = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    rows = lines.where(F.trim("value") != "").select("value", parsed.alias("_p"))
    tests = [F.col("_p").isNull() | F.col(f"_p.{_BROKEN}").isNotNull()]
    tests += [F.col(f"_p.{c}").isNull() for c in required]
    tests += [F.col(f"_p.{c}").isNotNull() & F.try_to_timestamp(f"_p.{c}").isNull() for c in stamps]
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, reasons(schema, required))])
    read = [
        (F.try_to_timestamp(f"_p.{f.name}") if f.name in stamps else F.col(f"_p.{f.name}")).alias(f.name) for f in schema.fields]
    out = rows.withColumn("reason", reason)
    return without_nan(out.select(*read, "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("line")))


def ingest_checked(
    spark: SparkSession, source: str, target: str, schema: T.StructType, required: Sequence[str]
) -> dict[str, int]:
    """Read JSON lines once and write good and rejected rows to one table, in a partition each; returns the counts.

    The counts (``lines``, ``good`` and one for each reason) are observed while the rows are written. Writing replaces the
    table, so a repeated run leaves the same.
    """
    counted = Observation()
    rows = checked_lines(spark.read.text(source), schema, required)
    kinds = reasons(schema, required)
    rows = rows.observe(
        counted, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("good"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in kinds])
    rows.withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(target)
    return counted.get


def _stored(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    fields = [*schema.fields, *[T.StructField(c, T.StringType()) for c in ("reason", "line")]]
    return spark.read.schema(T.StructType([*fields, T.StructField("rejected", T.BooleanType())])).parquet(target)


def good_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _stored(spark, target, schema).where(~F.col("rejected")).select(*schema.names)


def rejected_lines(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """``reason, line`` and the fields that could be read."""
    return _stored(spark, target, schema).where("rejected").select("reason", "line", *schema.names)
