"""Substring de-duplication by sliding spans of sentences.

Every run of ``span`` consecutive sentences is hashed to 128 bits and joined over the whole corpus. The first place of a
repeated run stays (smallest document, then smallest sentence number); sentences inside any later one are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, carried, identified, join_rows, restored
from lapspark.operators.joins import join_per_key

#: A segment ends after a run of stops or line feeds and the white space behind it.
SEGMENT = r"[^.!?\n]*[.!?\n]+[ \t\n\r\f\v]*|[^.!?\n]+"
_SEGMENT = re.compile(SEGMENT)


def segments(text: str) -> tuple[list[str], list[int]]:
    """All segments of a text (joined they give it) and the places of those that hold a sentence."""
    parts = _SEGMENT.findall(text)
    return parts, [i for i, p in enumerate(parts) if p.strip(" \t\n\r\f\v")]


def _span_rows(docs: DataFrame, kind: str, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number, digest = [], [], []
            for i, text in enumerate(batch.column("text")):
                parts, places = segments(text.as_py())
                keys = [parts[p].strip(" \t\n\r\f\v").encode() for p in places]
                # A text of fewer sentences is one span as a whole.
                runs = max(1, len(keys) - span + 1) if keys else 0
                doc.append(np.full(runs, i))
                number.append(np.arange(runs))
                digest += [xxhash.xxh3_128_digest(b"\n".join(keys[k:k + span])) for k in range(runs)]
            at = pa.array(np.concatenate(doc) if doc else np.zeros(0, np.int64))
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_row").take(at),
                 pa.array(np.concatenate(number) if number else np.zeros(0, np.int64)),
                 pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["doc_id", "_row", "number", "h1", "h2"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, _row long, number long, h1 long, h2 long")


def later_spans(docs: DataFrame, span: int = 3) -> DataFrame:
    """``doc_id, _row, numbers``: first sentences of the spans that occurred before, for ``identified`` documents."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_span_rows(docs, dict(docs.dtypes)["doc_id"], span), "spans")
    place = F.struct("doc_id", "_row", "number")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = join_per_key(rows, first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("_first")))
    found = Scratch(docs.sparkSession).table(
        later.groupBy("_row", "doc_id").agg(F.collect_set("number").alias("_numbers")), "later")
    scratch.drop()
    return found


def _kept(text: str, numbers: list[int] | None, span: int) -> tuple[str, int, int]:
    """The text without the sentences of later spans, how many sentences there were and how many are gone."""
    parts, places = segments(text)
    gone = {k for n in numbers or () for k in range(n, min(n + span, len(places)))}
    if not gone:
        return text, len(places), 0
    out = {places[k] for k in gone}
    return "".join([p for i, p in enumerate(parts) if i not in out]), len(places), len(gone)


def sentence_digest(docs: DataFrame, span: int = 3) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept_sha256`` for every row.

    Null text is empty and has no sentence; a text of fewer than ``span`` sentences is one span; rows with equal id and
    text are one document; an empty table gives no rows.
    """
    docs = identified(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t.as_py(), n, span) for t, n in zip(batch.column("text"), batch.column("_numbers").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_sentences", "n_removed", "kept_sha256"],
            )

    return join_rows(docs, later_spans(docs, span)).mapInArrow(
        run, f"doc_id {kind}, n_sentences long, n_removed long, kept_sha256 string")


def remove_later_spans(docs: DataFrame, span: int = 3) -> DataFrame:
    """``docs`` with the sentences of later spans removed from ``text``; ``n_chars``, if there, follows it."""
    joined = join_rows(carried(docs), later_spans(identified(docs), span)).select("text", "_numbers", "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                t.as_py() if not n or t.as_py() is None else _kept(t.as_py(), n, span)[0]
                for t, n in zip(batch.column("text"), batch.column("_numbers").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("_doc")], ["text", "_doc"])

    kept = joined.select("text", "_doc").schema
    return restored(joined.mapInArrow(run, kept), docs, fresh_size=True)
