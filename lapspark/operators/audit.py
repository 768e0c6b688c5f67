"""Log rollups, response-quality rates and chat-history limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.operators.laps import top_per_key
from lapspark.schemas import COMPLETION_PRICE_PER_MILLION, PROMPT_PRICE_PER_MILLION

HISTORY_LENGTH = 20
MESSAGE_LENGTH = 2000
REVISION_THRESHOLD = 7


def audit_cost(
    log: DataFrame,
    prompt_price: float = PROMPT_PRICE_PER_MILLION,
    completion_price: float = COMPLETION_PRICE_PER_MILLION,
) -> DataFrame:
    """Calls, success rate, latency, tokens and cost per feature, with one total row (null feature)."""
    calls = log.select(
        F.coalesce("feature", F.lit("unknown")).alias("feature"),
        F.coalesce("success", F.lit(False)).cast("int").alias("_ok"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("_latency"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("_prompt"),
        F.coalesce("completion_tokens", F.lit(0)).alias("_completion"),
    )
    rolled = calls.rollup("feature").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("_ok").alias("success_rate"),
        F.avg("_latency").alias("mean_latency_ms"),
        F.sum("_prompt").alias("prompt_tokens"),
        F.sum("_completion").alias("completion_tokens"),
    )
    cost = (
        F.col("prompt_tokens") / 1_000_000 * prompt_price
        + F.col("completion_tokens") / 1_000_000 * completion_price
    )
    return rolled.withColumn("estimated_cost_usd", cost)


def compliance_rates(attempts: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """First-pass, retry and failure rates from validated attempts.

    ``attempts`` holds one row per (feature, request, attempt 1 or 2) with ``is_valid``.
    """
    first = (F.col("attempt") == 1) & F.col("is_valid")
    second = (F.col("attempt") == 2) & F.col("is_valid")
    per_request = attempts.groupBy(*by, "request_id").agg(
        F.max(first.cast("int")).alias("_first"), F.max(second.cast("int")).alias("_second")
    )
    failed = (F.col("_first") == 0) & (F.col("_second") == 0)
    return per_request.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("_first").alias("first_pass_rate"),
        F.avg(((F.col("_first") == 0) & (F.col("_second") == 1)).cast("int")).alias("retry_rate"),
        F.avg(failed.cast("int")).alias("failure_rate"),
    )


def critique_quality(critiques: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean confidence, share needing a revision and mean number of factual errors."""
    parsed = critiques.where(F.col("error").isNull())
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("critiques"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("confidence") < REVISION_THRESHOLD).cast("int")).alias("revision_rate"),
        F.avg(F.size("factual_errors")).alias("mean_factual_errors"),
    )


def cap_history(
    messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", keep: int = HISTORY_LENGTH
) -> DataFrame:
    """The latest ``keep`` messages of each conversation, over-long ones cut and marked.

    Messages of one turn are taken in falling order of their text.
    """
    cut = F.when(
        F.length(text) > MESSAGE_LENGTH,
        F.concat(F.substring(text, 1, MESSAGE_LENGTH), F.lit(" [truncated]")),
    ).otherwise(F.col(text))
    kept = top_per_key(messages, [key], [F.desc(order), F.desc(text)], keep, "_back")
    return kept.drop("_back").withColumn(text, cut)
