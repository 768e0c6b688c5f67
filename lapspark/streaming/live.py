"""Structured Streaming: incremental tables, duplicate suppression and live analytics.

The stream checkpoint owns the read position, so no high-water mark is kept by hand. Rows beyond the
watermark are left out of the de-duplicated stream and counted in the query progress;
``add_late_rows`` adds them from the source table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lapspark import schemas
from lapspark.functions.scalar import add_seconds, nan_to_null, time_bucket
from lapspark.operators.laps import DRIVER, LAP, fastest_laps, gap_to_leader, normalise_laps, pace_summary, rolling_pace
from lapspark.operators.sketches import K, merge_sketches, quantile_sketches, sketch_quantiles
from lapspark.operators.stints import stint_degradation
from lapspark.operators.strategy import detect_undercuts, project_finish
from lapspark.session import file_names, materialize, remove_folder, scratch_tables
from lapspark.sources.tables import without_nan
from lapspark.streaming.keyed import use_state_store

WATERMARK = "10 minutes"
#: Length of the cells in which samples meet laps; an ordinary lap touches one or two.
CELL_SECONDS = 1800


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files of a landing folder as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_laps(spark, path, fmt="parquet", **options) -> DataFrame:
    return stream_table(spark, path, schemas.LAPS, fmt, **options)


def stream_stints(spark, path, fmt="parquet", **options) -> DataFrame:
    return stream_table(spark, path, schemas.STINTS, fmt, **options)


def stream_position(spark, path, fmt="parquet", **options) -> DataFrame:
    return stream_table(spark, path, schemas.POSITION, fmt, **options)


def stream_car_data(spark, path, fmt="parquet", **options) -> DataFrame:
    return stream_table(spark, path, schemas.CAR_DATA, fmt, **options)


def deduplicate(stream: DataFrame, keys: Sequence[str], event_time: str = "date", delay: str = WATERMARK) -> DataFrame:
    """Drop repeats of a key; state is kept only as long as the watermark allows."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def lap_samples(
    laps: DataFrame, car_data: DataFrame, longest: str = "30 minutes", delay: str = WATERMARK, slack_seconds: float = 0.5
) -> DataFrame:
    """Join of two streams: every sample with the timed lap it falls into (both ends inclusive, with a small tail).

    Both sides keep state only as far as the watermarks and ``longest``, the length of a lap that is still joined, need:
    a lap waits for its samples, and a sample for its lap, whichever comes first. Pit-out laps are left out, as for
    ``fastest_laps``. Rows beyond the watermark are not admitted.

    Both sides meet by driver and cell of time, each lap in all cells it touches, so a sample is compared with the laps
    around it and not with all laps of its driver.
    """
    use_state_store(laps.sparkSession)
    timed = laps.where(nan_to_null(F.col("lap_duration")).isNotNull() & F.col("date_start").isNotNull())
    if "is_pit_out_lap" in laps.columns:
        timed = timed.where(~F.col("is_pit_out_lap").eqNullSafe(True))
    timed = timed.withWatermark("date_start", delay).select(
        *[F.col(c).alias(f"_{c}") for c in DRIVER], "lap_number", F.col("lap_duration").alias("lap_time"), "date_start",
        add_seconds(F.col("date_start"), F.col("lap_duration") + slack_seconds).alias("_to"))
    until = F.least("_to", F.expr(f"date_start + INTERVAL {longest}"))
    first, last = time_bucket("date_start", CELL_SECONDS), time_bucket(until, CELL_SECONDS)
    timed = timed.withColumn("_cell", F.explode(F.when(first <= last, F.sequence(first, last))))
    points = car_data.where(F.col("date").isNotNull()).withWatermark("date", delay)
    inside = F.expr(f"date >= date_start AND date <= date_start + INTERVAL {longest} AND date <= _to")
    inside = inside & (time_bucket("date", CELL_SECONDS) == F.col("_cell"))
    for c in DRIVER:
        inside = inside & (F.col(c) == F.col(f"_{c}"))
    return points.join(timed, inside).drop(*[f"_{c}" for c in DRIVER], "_to", "_cell", "date_start")


def fastest_lap_samples(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Of stored ``lap_samples`` those of each driver's fastest lap by now."""
    best = fastest_laps(laps).where(F.col("date_start").isNotNull()).select(*LAP)
    return samples.join(best, LAP, "left_semi")


def latest_session(df: DataFrame) -> DataFrame:
    """Rows of the newest session only."""
    newest = df.agg(F.max("session_key").alias("session_key"))
    return df.join(F.broadcast(newest), "session_key", "left_semi")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _overwrite_sessions(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_key")
        .parquet(path)
    )


def _touched(batch: DataFrame) -> list[int]:
    """Sessions of a micro-batch: a few numbers that steer partition pruning."""
    return [r.session_key for r in batch.select("session_key").distinct().collect() if r.session_key is not None]


def upsert_latest_position(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function keeping the newest position per driver in a table by session.

    Taking a maximum is idempotent, so a replayed batch changes nothing.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        newest = F.max(F.struct("date", "position")).alias("_last")
        fresh = batch.where(F.col("position").isNotNull()).groupBy(*DRIVER).agg(newest)
        fresh = fresh.select(*DRIVER, "_last.position", "_last.date")
        old = _stored(batch.sparkSession, path)
        with scratch_tables(batch.sparkSession):
            if old is not None:
                old = old.select(*fresh.columns).where(F.col("session_key").isin(_touched(batch)))
                both = fresh.unionByName(old).groupBy(*DRIVER).agg(newest)
                fresh = both.select(*DRIVER, "_last.position", "_last.date")
            # The result is written before its own source is replaced.
            _overwrite_sessions(materialize(fresh), path)

    return apply


def latest_position_updates(position: DataFrame) -> DataFrame:
    """Most recent position per driver of a stream, for update mode: a batch sends out the drivers it changes.

    State is one entry for each driver ever seen.
    """
    newest = F.max(F.struct("date", "position")).alias("_last")
    known = position.where(F.col("position").isNotNull())
    return known.groupBy(*DRIVER).agg(newest).select(*DRIVER, "_last.position", "_last.date")


def start_updates(updates: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write what each batch changes into a folder of its own (``path/batch_id=…``), on a timer or once over everything.

    Nothing stored is read or rewritten, and a replayed batch overwrites its own folder with the same rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(updates, apply, checkpoint, interval, mode="update")


def current_positions(spark: SparkSession, path: str) -> DataFrame:
    """Latest position per driver from the changes written by ``start_updates``."""
    stored = _stored(spark, path)
    if stored is None:
        return spark.createDataFrame([], schemas.POSITION)
    rest = F.max_by(F.struct("position", "date"), "batch_id").alias("_row")
    return stored.groupBy(*DRIVER).agg(rest).select(*DRIVER, "_row.*")


def store_sketches(path: str, value: str, k: int = K) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function keeping one quantile sketch for each session and batch; a replay overwrites its own."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        sketches = quantile_sketches(batch, ["session_key"], value, k).withColumn("batch_id", F.lit(batch_id))
        sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return apply


def live_quantiles(spark: SparkSession, path: str, quantiles: Sequence[float]) -> DataFrame:
    """``session_key, n, estimates`` from the stored sketches of all batches."""
    return sketch_quantiles(merge_sketches(spark.read.parquet(path), ["session_key"]), quantiles)


Analytic = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

ANALYTICS: dict[str, Analytic] = {
    "rolling_pace": lambda laps, stints, position: rolling_pace(laps).select(*LAP, "rolling_pace"),
    "gap_to_leader": lambda laps, stints, position: gap_to_leader(laps),
    "pace_summary": lambda laps, stints, position: pace_summary(laps),
    "stint_degradation": lambda laps, stints, position: stint_degradation(laps, stints),
    "undercuts": lambda laps, stints, position: detect_undercuts(laps, stints, position),
    "projection": lambda laps, stints, position: project_finish(laps, stints, position),
}
#: What each of these reads; any other analytic may read every kind.
READS: dict[str, set[str]] = {
    "rolling_pace": {"laps"}, "gap_to_leader": {"laps"}, "pace_summary": {"laps"}, "stint_degradation": {"laps", "stints"},
}
#: Per kind of row: its schema and what makes a row replace an earlier one.
KINDS: dict[str, tuple[T.StructType, list[str]]] = {
    "laps": (schemas.LAPS, LAP),
    "stints": (schemas.STINTS, [*DRIVER, "stint_number"]),
    "position": (schemas.POSITION, [*DRIVER, "date"]),
}


def _session_rows(spark: SparkSession, store: str, kind: str, sessions: Sequence[int]) -> DataFrame:
    """Newest version of every stored row of these sessions; only their partitions are read."""
    schema, key = KINDS[kind]
    stored = _stored(spark, f"{store}/{kind}")
    if stored is None:
        return spark.createDataFrame([], schema)
    rows = stored.where(F.col("session_key").isin(list(sessions)))
    rest = [c for c in rows.columns if c not in (*key, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("_row") if rest else F.count(F.lit(1)).alias("_row")
    out = rows.groupBy(*key).agg(newest)
    return out.select(*key, "_row.*") if rest else out.select(*key)


#: One lock for each folder of results; the batches of its streams run in threads of one driver.
_PUBLISHING: dict[str, Lock] = defaultdict(Lock)


def live_analytics(
    store: str, results: str, kind: str = "laps", analytics: Mapping[str, Analytic] | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for one kind of rows (laps, stints or position): store, then recompute.

    Every batch lands in its own ``(session_key, batch_id)`` partitions of ``store/kind``, so replaying it overwrites
    the same files. Then the touched sessions are analysed as a whole, from all that is stored of the three kinds, by
    the analytics that read this kind (``READS``); the others have nothing new. Their
    partitions of the results are replaced, also by nothing if a correction leaves no row. Intermediates are removed
    when the batch is done.

    Streams that share a folder of results must run in one driver. There a batch stores, reads and publishes before the
    next one does, whichever stream it belongs to, so no batch can publish a state older than the published one.
    """
    wanted = dict(ANALYTICS if analytics is None else analytics)
    reads = {name: READS[name] if name in READS and fn is ANALYTICS[name] else set(KINDS) for name, fn in wanted.items()}
    wanted = {name: fn for name, fn in wanted.items() if kind in reads[name]}
    needed = set().union(*(reads[name] for name in wanted))

    def apply(batch: DataFrame, batch_id: int) -> None:
        with _PUBLISHING[results]:
            refresh(batch, batch_id)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sessions = _touched(batch)
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("session_key", "batch_id")
            .parquet(f"{store}/{kind}")
        )
        if not wanted:
            return
        with scratch_tables(spark):
            laps, stints, position = (
                materialize(_session_rows(spark, store, k, sessions)) if k in needed else spark.createDataFrame([], KINDS[k][0])
                for k in KINDS)
            laps = normalise_laps(without_nan(laps))
            for name, fn in wanted.items():
                folders = [f"{results}/{name}/session_key={session}" for session in sessions]
                before = [file_names(spark, folder) for folder in folders]
                _overwrite_sessions(fn(laps, stints, position), f"{results}/{name}")
                for folder, old in zip(folders, before):
                    # Files that are still there were not replaced: the session has no rows any more.
                    if old & file_names(spark, folder):
                        remove_folder(spark, folder)

    return apply


def add_late_rows(source: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append to a de-duplicated table the rows of ``source`` whose key it lacks, one for each key.

    This is the batch repair of what arrived beyond the watermark. Running it again adds nothing.
    """
    stored = _stored(source.sparkSession, path)
    fresh = source.dropDuplicates(list(keys))
    if stored is not None:
        fresh = fresh.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns)
    with scratch_tables(source.sparkSession):
        materialize(fresh).write.mode("append").parquet(path)


def start(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Run a batch function over a stream: on a timer, or once over everything available."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    start(stream, apply, checkpoint).awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to a parquet table, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
