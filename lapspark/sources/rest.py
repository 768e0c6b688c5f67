"""Backfill from a REST API as a Spark data source: one task per (endpoint, session).

Options: ``base_url``; ``endpoints`` and ``session_keys`` (comma separated); ``retries`` (3) and
``backoff`` (2.0) for the delays between attempts; ``on_error`` is ``fail`` (default: the task fails
after the last attempt) or ``report`` (the failure becomes a row with ``error`` set). Every source
row arrives as one JSON text, to be landed as is and parsed with an explicit schema.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lapspark.sources.tables import without_nan


class EndpointPartition(InputPartition):
    def __init__(self, endpoint: str, session_key: str) -> None:
        self.endpoint = endpoint
        self.session_key = session_key


class RestBackfillReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = options["base_url"].rstrip("/")
        self.endpoints = [e.strip() for e in options["endpoints"].split(",")]
        self.sessions = [k.strip() for k in options["session_keys"].split(",")]
        self.retries = int(options.get("retries", "3"))
        self.backoff = float(options.get("backoff", "2.0"))
        self.timeout = float(options.get("timeout", "10"))
        self.report = options.get("on_error", "fail") == "report"

    def partitions(self) -> list[InputPartition]:
        return [EndpointPartition(e, k) for e in self.endpoints for k in self.sessions]

    def read(self, partition: EndpointPartition) -> Iterator[tuple]:
        key = (partition.endpoint, partition.session_key)
        url = f"{self.base}/{partition.endpoint}?session_key={quote(partition.session_key)}"
        for attempt in range(1, self.retries + 1):
            try:
                with urlopen(url, timeout=self.timeout) as response:
                    rows = json.load(response)
                break
            except (OSError, ValueError) as exc:
                if attempt < self.retries:
                    time.sleep(self.backoff**attempt)
                elif self.report:
                    yield (*key, None, f"{type(exc).__name__}: {exc}")
                    return
                else:
                    raise
        for row in rows:
            yield (*key, json.dumps(row), None)


class RestBackfillSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "race_rest"

    def schema(self) -> str:
        return "endpoint string, session_key string, payload string, error string"

    def reader(self, schema: T.StructType) -> RestBackfillReader:
        return RestBackfillReader(self.options)


def read_rest(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(RestBackfillSource)
    return spark.read.format("race_rest").options(**options).load()


def parse_payload(raw: DataFrame, endpoint: str, schema: T.StructType) -> DataFrame:
    """Typed rows of one endpoint; absent fields, unreadable timestamps and NaN become null.

    ``extra`` holds the fields the schema does not name, as JSON text by name.
    """
    text = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema]
    )
    rows = raw.where((F.col("endpoint") == endpoint) & F.col("payload").isNotNull())
    fields = F.from_json("payload", "map<string,string>")
    known = F.array(*[F.lit(f.name) for f in schema])
    parsed = rows.select(
        F.from_json("payload", text).alias("_r"), F.map_filter(fields, lambda k, v: ~F.array_contains(known, k)).alias("extra")
    ).select("_r.*", "extra")
    stamps = [f.name for f in schema if isinstance(f.dataType, T.TimestampType)]
    return without_nan(parsed.withColumns({c: F.try_to_timestamp(c) for c in stamps}))
