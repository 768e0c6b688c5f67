"""Readers and writers for the race tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapspark import schemas
from lapspark.operators.laps import normalise_laps
from lapspark.schemas import SESSION_LABELS


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", session_key: int | None = None,
    extra: bool = False,
) -> DataFrame:
    """Rows of one table. Absent JSON fields read as null; timestamps that cannot be parsed become null, and so does
    NaN. A session filter reaches the partition directories.

    Further columns of Parquet files stay. Those of JSON files stay with ``extra``, which costs a pass over the files to
    find their names; without it the files are read once, by the schema.
    """
    if fmt == "json":
        text = T.StructType(
            [
                T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
                for f in schema.fields
            ]
        )
        if extra:
            found = spark.read.json(path).schema
            text = T.StructType([*text.fields, *[f for f in found.fields if f.name not in text.names]])
        df = spark.read.schema(text).json(path)
        stamps = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
        df = df.withColumns({c: F.try_to_timestamp(c) for c in stamps})
    else:
        df, _ = schemas.ensure_columns(spark.read.format(fmt).load(path), schema)
    df = without_nan(df)
    return df if session_key is None else df.where(F.col("session_key") == session_key)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in any column of doubles or floats becomes null."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floating})


def read_laps(spark, path, fmt="parquet", session_key=None) -> DataFrame:
    """Laps with ``date``, the lap's end, derived from start and duration where the files lack it."""
    return normalise_laps(read_table(spark, path, schemas.LAPS, fmt, session_key))


def read_stints(spark, path, fmt="parquet", session_key=None) -> DataFrame:
    return read_table(spark, path, schemas.STINTS, fmt, session_key)


def read_position(spark, path, fmt="parquet", session_key=None) -> DataFrame:
    return read_table(spark, path, schemas.POSITION, fmt, session_key)


def read_car_data(
    spark, path, fmt="parquet", session_key=None, driver_number=None, date_from=None, date_to=None
) -> DataFrame:
    """Car telemetry; driver and (inclusive) time range are pushed to the scan."""
    return car_data_between(
        read_table(spark, path, schemas.CAR_DATA, fmt, session_key), driver_number, date_from, date_to
    )


def car_data_between(car_data: DataFrame, driver_number=None, date_from=None, date_to=None) -> DataFrame:
    if driver_number is not None:
        car_data = car_data.where(F.col("driver_number") == driver_number)
    if date_from is not None:
        car_data = car_data.where(F.col("date") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        car_data = car_data.where(F.col("date") <= F.lit(date_to).cast("timestamp"))
    return car_data


def read_drivers(spark, path, fmt="parquet", session_key=None) -> DataFrame:
    return read_table(spark, path, schemas.DRIVERS, fmt, session_key)


def resolve_sessions(meetings: DataFrame, sessions: DataFrame, year: int, name: str) -> DataFrame:
    """Sessions of the meeting with that name and year (the lowest key if several match)."""
    chosen = (
        meetings.where((F.col("year") == year) & (F.col("meeting_name") == name))
        .agg(F.min("meeting_key").alias("meeting_key"))
    )
    return sessions.join(chosen, "meeting_key")


def default_session(sessions: DataFrame, order: Sequence[str] = ("date_start", "session_key")) -> DataFrame:
    """Per meeting: the first session named like a race and not a sprint, else the first one."""
    name = F.lower("session_name")
    race = name.contains("race") & ~name.contains("sprint")
    rest = [c for c in sessions.columns if c != "meeting_key"]
    best = F.min_by(F.struct(*rest), F.struct(~F.coalesce(race, F.lit(False)), *order))
    return sessions.groupBy("meeting_key").agg(best.alias("_s")).select("meeting_key", "_s.*")


def session_label(code: Column) -> Column:
    """Readable session type; an unknown code is its own label."""
    pairs = [F.lit(x) for kv in SESSION_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def session_meta(spark: SparkSession, session_key: int, year: int, grand_prix: str, code: str) -> DataFrame:
    row = spark.createDataFrame(
        [(session_key, year, grand_prix, code)],
        "session_key int, year int, grand_prix string, session_type string",
    )
    return row.withColumn("session_label", session_label(F.col("session_type")))


def write_by_session(df: DataFrame, path: str) -> None:
    """Overwrite only the sessions present in ``df``.

    Rows are gathered by session before writing, so files stay few; adaptive execution splits a hot
    session by its measured size, so it is not written by a single task.
    """
    (
        df.hint("rebalance", "session_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_key")
        .parquet(path)
    )


write_lap_features = write_by_session
write_session_meta = write_by_session


def read_lap_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def missing_outlines(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose outline is not stored yet."""
    return candidates.join(stored.select("gp_name").distinct(), "gp_name", "left_anti")


def refresh_outlines(spark: SparkSession, candidates: DataFrame, path: str) -> None:
    """Append outlines not stored yet; running it again adds nothing."""
    try:
        stored = spark.read.schema(schemas.OUTLINES).parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], schemas.OUTLINES)
    missing_outlines(candidates, stored).write.mode("append").parquet(path)


def append_audit_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit log lines; blank and malformed ones are skipped."""
    return spark.read.schema(schemas.AUDIT_LOG).option("mode", "DROPMALFORMED").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored metrics, or an empty table of the same shape when none were written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
