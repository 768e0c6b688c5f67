"""Race tables derived from the generic star-schema tables used for checking and benchmarking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapspark.functions.scalar import micros, sequence_bucket, time_bucket
from lapspark.operators.laps import DRIVER, LAP
from lapspark.operators.ordered import BUCKET, row_number_in_order, with_running
from lapspark.session import materialize

EPOCH = "2024-01-01 00:00:00"
STINT_LENGTH = 12
ORDERS_PER_LAP = 5000
#: A lap holds few lines of neighbouring orders, so its buckets span 2^20 order keys.
ORDER_BUCKET_BITS = 20


def _epoch() -> Column:
    """Start of the car data in microseconds, midnight in the session's time zone."""
    return micros(F.lit(EPOCH).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lap per event; the lap number is the event's place in its user's history."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("session_key"),
        F.col("user_id").alias("driver_number"),
        F.col("value").alias("lap_duration"),
        (F.col("event_type") == "signup").alias("is_pit_out_lap"),
        F.col("ts").cast("timestamp").alias("date"),
        "event_id",
    )
    numbered = row_number_in_order(
        events, DRIVER, ["date", "event_id"], time_bucket("date"), "lap_number"
    )
    return materialize(numbered.select(*LAP, "lap_duration", "is_pit_out_lap", "date"))


def stints(lap_table: DataFrame) -> DataFrame:
    number = F.floor((F.col("lap_number") - 1) / STINT_LENGTH) + 1
    compound = (
        F.when(F.col("stint_number") % 3 == 1, "SOFT")
        .when(F.col("stint_number") % 3 == 2, "MEDIUM")
        .otherwise("HARD")
    )
    return (
        lap_table.groupBy(*DRIVER, number.alias("stint_number"))
        .agg(F.min("lap_number").alias("lap_start"), F.max("lap_number").alias("lap_end"))
        .select(
            *DRIVER, "stint_number", compound.alias("compound"),
            (F.col("driver_number") % 4).alias("tyre_age_at_start"), "lap_start", "lap_end",
        )
    )


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("session_key"),
        F.col("user_id").alias("driver_number"),
        (F.col("event_id") % 20 + 1).alias("position"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("date"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 5).alias("session_key"),
        F.col("c_custkey").alias("driver_number"),
        F.when(F.col("c_acctbal") >= 0, F.upper(F.substring("c_mktsegment", 1, 3))).alias("name_acronym"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit("TEAM "), F.col("c_nationkey").cast("string")).alias("team_name"),
        F.concat(F.lit("ff00"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("team_colour"),
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("meeting_key"),
        F.col("n_name").alias("meeting_name"),
        (F.col("n_regionkey") + 2020).alias("year"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Race")
        .when(F.col("o_orderpriority") == "2-HIGH", "Sprint Race")
        .otherwise("Practice")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_key"),
        (F.col("o_custkey") % 25).cast("int").alias("meeting_key"),
        name.alias("session_name"),
        F.col("o_orderstatus").alias("session_type"),
        F.col("o_orderdate").cast("timestamp").alias("date_start"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance-stamped telemetry from line items: supplier = driver, five laps each.

    The rows keep ``_bucket``, by which they are dealt: resampling goes on inside these buckets, so samples are neither
    written nor shuffled again.
    """
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {
            "session_key": F.col("l_suppkey") % 5,
            "driver_number": F.col("l_suppkey"),
            "lap_number": F.col("l_partkey") % 5 + 1,
        }
    )
    placed = with_running(
        lines, LAP, order, sequence_bucket("l_orderkey", bits=ORDER_BUCKET_BITS),
        sums={"sample_no": F.lit(1).cast("long"), "distance": F.col("l_quantity")}, keep_bucket=True,
    )
    return placed.select(
        *LAP,
        "sample_no",
        "distance",
        (F.col("l_extendedprice") / 300).alias("speed"),
        (F.col("l_discount") * 1000).alias("throttle"),
        (F.col("l_tax") * 100).alias("brake"),
        F.col("l_linenumber").cast("double").alias("n_gear"),
        (F.col("l_quantity") * 200).alias("rpm"),
        (F.col("l_extendedprice") / 100).alias("x"),
        (F.col("l_orderkey") / 10).alias("y"),
        (F.col("l_discount") - F.col("l_tax")).alias("steer"),
        BUCKET,
    )


def sample_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap times of the telemetry laps."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % 5).alias("session_key"),
            F.col("l_suppkey").alias("driver_number"),
            (F.col("l_partkey") % 5 + 1).alias("lap_number"),
        )
        .agg((F.sum("l_quantity") % 60 + 60).alias("lap_time_seconds"))
    )


def car_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped telemetry from line items, one sample per supplier and instant."""
    stamp = _epoch() + F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("driver_number"), F.timestamp_micros(stamp).alias("date"))
        .agg(
            F.max("l_extendedprice").alias("_price"),
            F.max("l_discount").alias("_discount"),
            F.max("l_tax").alias("_tax"),
            F.max("l_linenumber").alias("n_gear"),
            F.max("l_quantity").alias("_quantity"),
        )
        .select(
            (F.col("driver_number") % 5).alias("session_key"),
            "driver_number",
            "date",
            (F.col("_price") / 300).alias("speed"),
            (F.col("_discount") * 1000).alias("throttle"),
            (F.col("_tax") * 100).alias("brake"),
            "n_gear",
            (F.col("_quantity") * 200).alias("rpm"),
        )
    )


def car_laps(car: DataFrame) -> DataFrame:
    """Timed laps cut from the car data: 5000 seconds of samples each."""
    lap = F.floor((micros("date") - _epoch()) / (ORDERS_PER_LAP * 1_000_000)) + 1
    return (
        car.groupBy("session_key", "driver_number", lap.alias("lap_number"))
        .agg(F.min("date").alias("date_start"), F.max("date").alias("_end"))
        .select(
            *LAP,
            ((micros("_end") - micros("date_start")) / 1_000_000.0).alias("lap_duration"),
            F.lit(False).alias("is_pit_out_lap"),
            "date_start",
        )
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("string").alias("ts"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("feature"),
        F.lit("model").alias("model"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"),
        (F.col("event_id") % 500).alias("completion_tokens"),
        (F.col("event_type") != "error").alias("success"),
    )


CRITIQUE_JSON = """CASE turn % 6
  WHEN 0 THEN concat('{"confidence": ', CAST(conv_id % 13 AS STRING), ', "factual_errors": ["a<b", "t',
    CAST(turn AS STRING), '", "c", "d", "e", "f"], "suggested_improvements": ["u", "v", "w", "x"]}')
  WHEN 1 THEN concat('{"confidence": "', CAST(conv_id % 20 AS STRING), '", "factual_errors": []}')
  WHEN 2 THEN '{"factual_errors": "none", "suggested_improvements": ["only one"]}'
  WHEN 3 THEN '[1, 2]'
  WHEN 4 THEN concat('{"confidence": ', CAST(conv_id % 11 - 3 AS STRING), '.7}')
  ELSE 'plain text {' END"""

REPORT_JSON = """CASE WHEN conv_id % 17 = 3 THEN 'no report {' WHEN conv_id % 17 = 5 THEN '["no object"]' ELSE
  concat('{"headline": ', CASE WHEN conv_id % 17 = 7 THEN '17' ELSE concat('"h <b>', CAST(conv_id AS STRING), '</b>"') END,
  CASE WHEN conv_id % 7 = 1 THEN '' ELSE concat(', "strengths": ["s1", "<s2>"',
    CASE WHEN conv_id % 5 = 2 THEN '' ELSE ', "s3"' END, ']') END,
  ', "weaknesses": ', CASE WHEN turn = 3 THEN '"slow"' ELSE '["w1", "w2", "w3"]' END,
  ', "race_craft_rating": ', CAST(conv_id % 12 AS STRING),
  ', "raw_pace_rating": "', CAST(turn % 10 + 1 AS STRING), '"',
  ', "consistency_rating": ', CASE WHEN conv_id % 9 = 4 THEN 'null' ELSE CAST(conv_id % 9 + 1 AS STRING) END,
  ', "tactical_tips": ["t1", ', CASE WHEN turn = 2 THEN '2' ELSE '"t2"' END, ']',
  ', "style_tags": ["a", "b", "c", "d", "e", "f"]}') END"""


def critiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("feature"), F.expr(CRITIQUE_JSON).alias("response")
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(REPORT_JSON).alias("response")
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embedding per label as the profile table."""
    points = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = points.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_p"))
    return packed.select(
        F.concat(F.lit("profile "), F.col("label").cast("string")).alias("name"),
        F.col("_p.m").alias("vector"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
