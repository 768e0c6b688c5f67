"""Data-quality checks: feature bounds, membership, JSON responses and free text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.functions.scalar import nan_to_null
from lapspark.schemas import ARGUMENT_LIMITS, FEATURE_BOUNDS, MODEL_FEATURES, OTHER_BOUNDS

# --- fixed values: limits and report layout ---
MAX_MESSAGE_CHARS = 500
MAX_FACTUAL_ERRORS = 5
MAX_IMPROVEMENTS = 3
REPORT_FIELDS = [
    # name, kind, minimum, maximum
    ("headline", "string", None, None),
    ("strengths", "list", 3, 3),
    ("weaknesses", "list", 2, 2),
    ("race_craft_rating", "integer", 1, 10),
    ("raw_pace_rating", "integer", 1, 10),
    ("consistency_rating", "integer", 1, 10),
    ("tactical_tips", "list", 2, 2),
    ("style_tags", "list", 3, 5),
]
# --- end of fixed values ---


def check_bounds(
    df: DataFrame, features: Sequence[str], bounds: Mapping[str, tuple[float, float]] = FEATURE_BOUNDS
) -> DataFrame:
    """First failing rule per row: not numeric, not finite, then outside the feature's range."""
    reason = F.lit(None).cast("string")
    for f in reversed(list(features)):
        lo, hi = bounds.get(f, OTHER_BOUNDS)
        number = F.col(f).try_cast("double")
        finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
        reason = (
            F.when(number.isNull(), F.lit(f"{f}: not numeric"))
            .when(~finite, F.lit(f"{f}: not finite"))
            .when(~number.between(lo, hi), F.lit(f"{f}: outside [{lo}, {hi}]"))
            .otherwise(reason)
        )
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def check_membership(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not in the reference set."""
    return df.join(known.select(column).distinct(), [column], "left_anti")


def training_rows(laps: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Missing steering spread means zero; any other missing feature drops the row."""
    clean = laps.withColumns({f: nan_to_null(F.col(f).cast("double")) for f in features})
    if "steer_std" in features:
        clean = clean.fillna(0.0, subset=["steer_std"])
    return clean.dropna(subset=list(features))


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(doc: str, name: str, kind: str) -> Column:
    return F.try_variant_get(F.col(doc), f"$.{name}", kind)


def _to_int(doc: str, name: str) -> tuple[Column, Column]:
    """(present and convertible, value): numbers truncate, numeric text parses, booleans are 0/1."""
    kind = _type(_field(doc, name, "variant"))
    text = F.trim(_field(doc, name, "string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))
    number = F.when(
        kind == "BOOLEAN", _field(doc, name, "boolean").cast("long")
    ).when(
        kind == "STRING", whole
    ).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), _field(doc, name, "double").try_cast("long")
    )
    return number.isNotNull(), number


def _as_list(doc: str, name: str, keep: int) -> Column:
    items = _field(doc, name, "array<variant>")
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    return F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, keep)


def parse_critique(responses: DataFrame, column: str = "response") -> DataFrame:
    """Confidence (1-10, default 10), at most five errors and three improvements, or an error."""
    doc = responses.withColumn("_doc", F.try_parse_json(column))
    parsed = F.col("_doc").isNotNull()
    is_object = _type(F.col("_doc")).startswith("OBJECT")
    kind = _type(_field("_doc", "confidence", "variant"))
    ok, value = _to_int("_doc", "confidence")
    present = kind.isNotNull()
    error = (
        F.when(~parsed, "not json")
        .when(~is_object, "not an object")
        .when(present & ~ok, "bad confidence")
    )
    confidence = F.greatest(F.lit(1), F.least(F.lit(10), F.when(present, value).otherwise(F.lit(10))))
    good = error.isNull()
    return doc.withColumns(
        {
            "error": error,
            "confidence": F.when(good, confidence.cast("long")),
            "factual_errors": F.when(good, _as_list("_doc", "factual_errors", MAX_FACTUAL_ERRORS)),
            "suggested_improvements": F.when(
                good, _as_list("_doc", "suggested_improvements", MAX_IMPROVEMENTS)
            ),
        }
    ).drop("_doc")


def validate_report(responses: DataFrame, column: str = "response") -> DataFrame:
    """Ordered schema rules; the first failure is reported, otherwise the cleaned report.

    Integers are coerced, over-long lists are cut, and angle brackets are removed from text.
    """
    doc = responses.withColumn("_doc", F.try_parse_json(column))
    reason = F.lit(None).cast("string")
    cleaned = []
    for name, kind, lo, hi in reversed(REPORT_FIELDS):
        found = _type(_field("_doc", name, "variant"))
        missing = found.isNull()
        if kind == "integer":
            ok, value = _to_int("_doc", name)
            reason = (
                F.when(missing, f"{name}: missing")
                .when(~ok, f"{name}: not an integer")
                .when(~value.between(lo, hi), f"{name}: out of range")
                .otherwise(reason)
            )
            cleaned.append(value.alias(name))
        elif kind == "list":
            items = _field("_doc", name, "array<variant>")
            kept = F.slice(items, 1, hi)
            alien = F.exists(kept, lambda v: ~F.coalesce(_type(v) == "STRING", F.lit(False)))
            reason = (
                F.when(missing, f"{name}: missing")
                .when(~found.startswith("ARRAY"), f"{name}: not a list")
                .when(F.size(items) < lo, f"{name}: too few items")
                .when(alien, f"{name}: item is not text")
                .otherwise(reason)
            )
            texts = F.transform(kept, lambda v: F.translate(F.try_variant_get(v, "$", "string"), "<>", ""))
            cleaned.append(texts.alias(name))
        else:
            reason = (
                F.when(missing, f"{name}: missing")
                .when(found != "STRING", f"{name}: not text")
                .otherwise(reason)
            )
            cleaned.append(F.translate(_field("_doc", name, "string"), "<>", "").alias(name))
    reason = (
        F.when(F.col("_doc").isNull(), F.lit("not json"))
        .when(~_type(F.col("_doc")).startswith("OBJECT"), F.lit("not an object"))
        .otherwise(reason)
    )
    checked = doc.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
    report = F.when(F.col("is_valid"), F.struct(*reversed(cleaned)))
    return checked.withColumn("report", report).drop("_doc")


def sanitize_text(messages: DataFrame, column: str = "text") -> DataFrame:
    """Trim, reject empty or over-long text, drop control characters except newline and tab."""
    blank = r"[\s\x1C-\x1F\x85\p{Z}]"
    trimmed = F.regexp_replace(F.col(column), f"^{blank}+|{blank}+$", "")
    cleaned = F.regexp_replace("_trimmed", r"[\x00-\x08\x0B-\x1F]", "")
    out = messages.withColumn("_trimmed", trimmed).withColumn("_cleaned", cleaned)
    error = (
        F.when(F.length("_trimmed") == 0, "empty")
        .when(F.length("_trimmed") > MAX_MESSAGE_CHARS, "too long")
        .when(F.length("_cleaned") == 0, "only control characters")
    )
    out = out.withColumn("error", error)
    return out.withColumn(
        "cleaned", F.when(F.col("error").isNull(), F.col("_cleaned")).otherwise(F.lit(""))
    ).drop("_trimmed", "_cleaned")


def check_arguments(requests: DataFrame, limits: Mapping[str, tuple[int, int]] = ARGUMENT_LIMITS) -> DataFrame:
    """Text arguments as integers inside their limits, with ``error`` for the first one that is no integer.

    A missing argument takes the lower limit; a request with an error has no values. The operators themselves take any
    valid value, so these limits hold for requests only.
    """
    number = {name: F.col(name).try_cast("int") for name in limits}
    error = F.lit(None).cast("string")
    for name in reversed(list(limits)):
        wrong = F.col(name).isNotNull() & number[name].isNull()
        error = F.when(wrong, F.concat(F.lit(f"{name} must be int, got "), F.col(name))).otherwise(error)
    checked = requests.withColumn("error", error)
    return checked.withColumns({
        name: F.when(F.col("error").isNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(number[name], F.lit(lo)))))
        for name, (lo, hi) in limits.items()
    })


def clamp_argument(value, lowest: int, highest: int) -> int:
    """Integer argument inside a range; a missing one takes the lower bound."""
    return lowest if value is None else max(lowest, min(int(value), highest))
