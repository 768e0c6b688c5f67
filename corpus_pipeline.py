"""A corpus pipeline: reject poor documents, keep one of each group of near copies, cut repeated passages, redact live
secrets, and pack what remains.

Each stage reads the whole output of the one before. ``ORACLE_SQL`` is None: trained scores, fingerprint components and
bucket refinement are not expressible in SQL, so ``tests/llm`` holds the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapspark.llm import packing, quality_gam, secret_scan, simhash, suffix_dedup
from lapspark.llm.common import read
from lapspark.llm.doc_stats import quality_labels
from lapspark.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_gam.keep_good(docs, quality_labels(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, exact similarity 0.8 or more)."""
    return simhash.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its strings of 250 bytes and its runs of 51 words that stand elsewhere too.

    So every passage of more than fifty words goes, also where its words are so short that it has under 250 bytes.
    """
    return suffix_dedup.remove_repeats(docs, length=250, words=51)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its live-looking, owner-specific credentials redacted."""
    return secret_scan.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
