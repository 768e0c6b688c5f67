"""What the corpus operators share: reading a table, row identity, numbering, scratch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapspark.operators.joins import join_per_key
from lapspark.session import shared_dir, shuffles_removed


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text column, a null counting as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def bare(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``doc_id``, the whole text and ``columns``, whatever else the table holds."""
    return docs.select("doc_id", whole_text().alias("text"), *columns)


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """``bare`` with ``_row``, which tells rows of one ``doc_id`` (or of none) apart by their text.

    Rows that agree in both are interchangeable for every operator here: they get equal results.
    """
    return bare(docs, *columns).withColumn("_row", F.xxhash64("doc_id", "text"))


def join_rows(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each ``_row`` and ``doc_id``."""
    right = right.withColumnsRenamed({"_row": "_right_row", "doc_id": "_right_id"})
    same = (F.col("_row") == F.col("_right_row")) & F.col("doc_id").eqNullSafe(F.col("_right_id"))
    return left.join(right, same, how).drop("_right_row", "_right_id")


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _row`` as in ``identified`` (the text as it is), everything else of ``docs`` inside ``_doc``.

    So no column of the input can clash with an inner one; ``restored`` undoes it.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", whole_text()).alias("_row"), F.struct(*others).alias("_doc"))


def restored(work: DataFrame, docs: DataFrame, fresh_size: bool = False) -> DataFrame:
    """The columns of ``docs`` from a ``carried`` table; ``n_chars`` is counted again if ``fresh_size``."""
    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars" and fresh_size:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"_doc.`{c}`").alias(c)

    return work.select(*map(column, docs.columns))


def numbered(rows: DataFrame, key: str, order: Sequence[Column], scratch: Scratch, name: str = "ordered") -> DataFrame:
    """``rows`` with ``_pos``, the place (from 0) of a row among those of its ``key``, and ``_n``, how many these are.

    ``key`` holds no null. All rows are sorted at once by ranges of (key, order), so a key with most of the rows is dealt
    over many tasks, and rows equal in all of it by where they stood; what one task sees are counts of ranges.
    """
    placed = scratch.table(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    by = [F.col(key), *order, F.col("_tie")]
    # Identifiers ascend over the ranges and inside each.
    dealt = placed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.table(dealt.drop("_tie"), name).withColumn("_range", F.shiftright("_at", 33))
    scratch.drop(f"{name}-rows")
    ranges = dealt.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        key, "_range", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_n"))
    found = join_per_key(dealt, ranges, [key, "_range"])
    return found.withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


class Scratch:
    """Parquet tables in the folder all executors share; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
