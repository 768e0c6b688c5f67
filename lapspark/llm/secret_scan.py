"""Secret scanning with corpus-wide ownership frequency (DataFrame functions only).

Every candidate credential is hashed; each hash is counted over the distinct repositories and owners it occurs in.
A value that several owners share is a copied example; a value of one owner that looks like a real key is live.

Positions are code points, ends exclusive. ``split`` and ``regexp_extract_all`` with one pattern give alternately the
text between matches and the matches, so running lengths are the positions and no text is scanned per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapspark.llm.common import Scratch, carried, identified, join_rows, restored
from lapspark.operators.joins import join_per_key


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The kinds of the base scan. ``{16,}`` and ``{14,}`` after the prefix find the same matches as the open
# patterns with a minimum length, because a run that is too short holds no longer match that starts inside it.
ASSIGN = (
    "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
EXAMPLE = "example|sample|dummy|changeme|placeholder|xxxx|0000|1234"

_SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"


def _spans(text: Column, pattern: str, rank: int, value_group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as spans; those whose value is shorter than ``least`` are dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(
            start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"),
            part["value"].alias("value"),
        )
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans


def _looks_live(value: Column) -> Column:
    """Letters and digits, at least eight different characters, and none of the usual filler words."""
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike(EXAMPLE)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    )


def _written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One narrow row per document: ``doc_id, _row, owner, repository, base, extra`` (sorted spans)."""
    d = identified(
        docs, F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository")
    )
    text = F.col("text")
    base = F.array_sort(
        F.concat(_spans(text, ASSIGN, 0, 2, 12), _spans(text, ACCESS, 1, 0, 0), _spans(text, HEX, 2, 0, 0))
    )
    extra = F.filter(_spans(text, OPAQUE, 3, 0, 0), lambda s: _looks_live(s["value"]))
    return d.select("doc_id", "_row", "owner", "repository", base.alias("base"), extra.alias("extra"))


def _occurrences(found: DataFrame) -> DataFrame:
    """One row per span with the hash of its value."""
    spans = F.explode(F.concat("base", "extra"))
    return found.select("doc_id", "_row", "owner", "repository", spans.alias("span")).select(
        "doc_id", "_row", "owner", "repository", "span.start", "span.rank", "span.end",
        F.sha2(F.col("span.value"), 256).alias("hash"), _looks_live(F.col("span.value")).alias("looks_live"),
    )


def _frequency(occurrences: DataFrame) -> DataFrame:
    # The distinct triples come first, so a hash in a third of all documents is spread over its repositories.
    # A missing owner or repository counts as one of its own.
    triples = occurrences.select(
        "hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")
    ).distinct()
    repositories = triples.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    owners = triples.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repositories.join(owners, "hash")


def ownership(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``hash, n_repositories, n_owners`` of every candidate value in the corpus."""
    scratch = Scratch(docs.sparkSession)
    return _frequency(_occurrences(scratch.table(candidates(docs, owner, repository), "secrets")))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 1) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live``.

    Base spans always stay. Opaque tokens that look live, belong to at most ``max_owners`` owners and touch no base span
    are added as ``opaque``. ``n_live`` counts the spans (base or added) with a live verdict, ``n_copied`` those whose
    value has more owners; ``live`` holds the live spans for redaction. Null or empty text has no spans; a missing owner
    or repository counts as one more; repeated rows get equal results and are one repository; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(candidates(docs, owner, repository), "secrets")
    occurrences = _occurrences(found)
    # Distinct, because repeated rows would show each span more than once.
    counted = join_per_key(occurrences.drop("owner", "repository").distinct(), _frequency(occurrences), ["hash"])
    verdict = counted.withColumn("is_live", F.col("looks_live") & (F.col("n_owners") <= max_owners))
    row = Window.partitionBy("_row", "doc_id").orderBy("start", "rank")
    is_base = F.col("rank") < 3
    before = F.max(F.when(is_base, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = verdict.withColumn("clear", clear).where(is_base | (F.col("is_live") & F.col("clear")))
    span = F.struct("start", "rank", "end")
    per_row = kept.groupBy("_row", "doc_id").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.col("is_live"), span))).alias("live"),
        F.count(F.when(F.col("is_live"), 1)).alias("n_live"),
        F.count(F.when(F.col("n_owners") > max_owners, 1)).alias("n_copied"),
    )
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return join_rows(found, per_row).select(
        "doc_id", "_row",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_written(F.col("spans")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("live", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")).alias("live"),
    )


def redact_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 1,
                   mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live spans replaced by ``mark``; ``n_chars``, if there, follows the text, all else stays."""
    live = scan_secrets(docs, owner, repository, max_owners).where("n_live > 0").select("doc_id", "_row", "live").distinct()
    def step(acc: Column, s: Column) -> Column:
        # A span that overlaps the one before only continues the cut.
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.when(fresh, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("live", start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    found = join_rows(carried(docs), live)
    text = F.when(F.col("live").isNull(), F.col("text")).otherwise(cut)
    return restored(found.withColumn("text", text), docs, fresh_size=True)
