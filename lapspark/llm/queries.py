"""The corpus queries, one for each operator, with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapspark.llm import (
    bpe, importance, merkle, minhash, packing, quality_gam, quality_gbt, secret_scan, sentence_spans, simhash, sql, suffix_dedup,
    token_count, topk,
)
from lapspark.llm.common import read
from lapspark.llm.doc_stats import quality_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    if hasattr(sql, fn.__name__.upper()):
        ORACLES[fn.__name__] = getattr(sql, fn.__name__.upper())
    return fn


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, owner-specific opaque spans and ownership counts of every document."""
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents")).drop("_row", "live")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document with word-end BPE."""
    return bpe.encoding_digest(read(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its 400-byte strings that occur elsewhere."""
    return suffix_dedup.removal_digest(read(spark, sf_dir, "documents"))


@query
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its sentences in later copies of a span."""
    return sentence_spans.sentence_digest(read(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.fingerprint_digest(read(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_gam.score_quality(read(spark, sf_dir, "documents"), quality_labels(spark, sf_dir)).drop("_row")


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector by integer inner product."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token count of every document."""
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2,048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality_gbt.judge(read(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, score and rank of every document, with ``benchmark`` as the target."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return minhash.component_digest(read(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and folded root of every document."""
    return merkle.manifest(read(spark, sf_dir, "documents"))
