"""Target-distribution importance resampling on hashed n-grams.

The texts of a batch are joined with a separator between them, one regex pass finds all words, and the places where texts
begin (``searchsorted``) tell which neighbouring words belong to one document: n-grams across two documents are masked
before buckets are counted with ``bincount``. The CRC-32 of an n-gram comes from those of its words, because
``crc(a + b)`` is ``crc(a)`` shifted over the length of ``b``, xor ``crc(b)``; no n-gram is built as a string.

Counts of all documents and of all target texts give one gain for each bucket, a table whose size is a parameter. A second
pass adds the gains of each document, and the drawing is by Gumbel noise from the document's id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, numbered, whole_text

#: Buckets of the hashed features; two counts and one gain of each pass through the driver.
BUCKETS = 10_000
ORDER = 3
#: Bytes of joined text that are worked on at once; a longer text is cut between words.
BUFFER = 1 << 21

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: No word holds it, so no word runs from one text into the next.
_SEPARATOR = b"\n"
#: Lengths with a table of their own.
_LONG = 64


def _shift_tables() -> np.ndarray:
    """``[length, byte of the state, value]``: what the CRC-32 register becomes after so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> np.uint32(1) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    value = np.arange(256, dtype=np.uint32)
    tables = [np.stack([value << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_LONG):
        tables.append(tables[-1] >> np.uint32(8) ^ step[tables[-1] & np.uint32(255)])
    return np.stack(tables)


_SHIFT = _shift_tables().reshape(-1)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` after ``length`` more zero bytes: ``crc32(a + b) = shifted(crc32(a), len(b)) ^ crc32(b)``."""
    long = length > _LONG
    if long.any():
        crc, length = crc.copy(), length.copy()
        while long.any():
            crc[long] = shifted(crc[long], np.full(int(long.sum()), _LONG))
            length[long] -= _LONG
            long = length > _LONG
    at = length * 1024
    out = _SHIFT[at + (crc & np.uint32(255))]
    for k in range(1, 4):
        out ^= _SHIFT[at + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(255))]
    return out


def _slabs(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """First document, joined lower-cased texts and where each begins; a long text comes in several slabs of whole words."""
    some: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        if some and size + len(text) > BUFFER:
            yield first, *_joined(some)
            some, size = [], 0
        if not some:
            first = i
        some.append(text)
        size += len(text) + 1
    if some:
        yield first, *_joined(some)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    begin = np.cumsum([0, *(len(t) + len(_SEPARATOR) for t in texts)])[:-1]
    return _SEPARATOR.join(texts).lower(), begin


def _pieces(joined: bytes) -> Iterator[tuple[int, int]]:
    """Cuts of a buffer into parts of about ``BUFFER`` bytes that end between two words."""
    start = 0
    while start < len(joined):
        stop = start + BUFFER
        word = _WORD.match(joined, stop) if stop < len(joined) else None
        stop = min(word.end() if word else stop, len(joined))
        yield start, stop
        start = stop


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of each document (as document numbers), and document and bucket of each n-gram, in parts.

    The last words of a part go before the next one, so runs of a long text that is cut are found as well; a word counts
    in the part that holds it.
    """
    for first, joined, begin in _slabs(texts):
        doc, length, crc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for start, stop in _pieces(joined):
            found = [(m.start(), m[0]) for m in _WORD.finditer(joined, start, stop)]
            if not found:
                continue
            words = [w for _, w in found]
            at = np.fromiter((s for s, _ in found), np.int64, len(found))
            before = min(ORDER - 1, len(doc))
            doc = np.r_[doc[len(doc) - before:], np.searchsorted(begin, at, "right") - 1]
            length = np.r_[length[len(length) - before:], np.fromiter(map(len, words), np.int64, len(words))]
            crc = np.r_[crc[len(crc) - before:], np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
            spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
            of, bucket, gram = [], [], crc
            for k in range(ORDER):
                if k:
                    gram = shifted(gram[:-1], length[k:] + 1) ^ spaced[k:]
                inside = doc[k:] == doc[:len(doc) - k]
                # Those that end among the words carried over have been counted.
                inside[:max(0, before - k)] = False
                of.append(doc[k:][inside])
                bucket.append(gram[inside] % np.uint32(BUCKETS))
            yield first + of[0], first + np.concatenate(of), np.concatenate(bucket).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all rows of ``text`` fall into each bucket; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket in features(_texts(batch)):
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight, in thousandths."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, grams, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for word_doc, doc, bucket in features(_texts(batch)):
                words += np.bincount(word_doc, minlength=n)
                grams += np.bincount(doc, minlength=n)
                weight += np.bincount(doc, gain[bucket], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(grams), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the id; rows without one share that of an empty id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; drawn are ``percent`` of a hundred.

    Of all rows with ``least_words`` words the highest scores are drawn, ties to the smaller ``doc_id``, rows without one
    last, repeated rows in any order; ``rank`` is null for the rest. Null or empty texts have no feature and weight 0; an
    empty target or an empty table is no error (counts are zero); other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = docs.select("doc_id", whole_text().alias("text"))
    gain = gains(bucket_counts(text.select("text")), bucket_counts(target.select(whole_text().alias("text"))))
    rows = _weighed(text, gain, dict(docs.dtypes)["doc_id"]).withColumn("score", F.col("weight") + _noise(seed))
    rows = rows.withColumn("long_enough", F.when(F.col("n_words") >= least_words, "yes").otherwise("no"))
    ranked = numbered(rows, "long_enough", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], scratch, "scores")
    drawn = (F.col("long_enough") == "yes") & (F.col("_pos") < F.floor(F.col("_n") * percent / 100))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_pos") + 1).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, all columns; of rows with one id all stay if one is drawn."""
    chosen = resample(docs, target, percent, least_words, seed).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi")
