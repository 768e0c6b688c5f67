"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lapspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or by ``setCheckpointDir``).

    Only a local session may fall back to a temporary folder, in tests: on a cluster a machine-local folder would be
    lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lapspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


_RUN = uuid.uuid4().hex
#: Open scopes of this thread: batch functions of several streams run at the same time, each with its own.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("lapspark_scopes", default=())


def _run_dir(spark: SparkSession) -> str:
    return "/".join([_shared_base(spark).rstrip("/"), f"lapspark-{_RUN}", *_SCOPES.get()])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is written inside go when it ends, not when the driver happens to collect garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several branches read, and continue from the copy.

    An ordered operator reads its input twice; without this, a chain of them would read its source
    a number of times that doubles at every step. The copy is a parquet table in the shared folder:
    it survives lost executors and each branch reads only the columns it needs.
    """
    path = shared_dir(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def file_names(spark: SparkSession, path: str) -> set[str]:
    """Names of the files in a folder; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(place)} if files.exists(place) else set()


def drop_materialized(spark: SparkSession) -> None:
    """Remove every table this run has written to the shared folder (call when it is over)."""
    remove_folder(spark, _run_dir(spark))


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at the end; results must be written before."""
    before = _SCOPES.set((*_SCOPES.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        try:
            drop_materialized(spark)
        finally:
            _SCOPES.reset(before)
