"""Statistics of whole documents that the two quality models learn from.

Words are runs of anything but ASCII white space, lines are cut at line feeds. Byte counts come from one histogram of the
text's UTF-8 bytes; nothing but the words of one document is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, identified, read

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "digit_share", "upper_share", "stops_per_word", "marks_per_word",
    "bars_per_word", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "short_word_share",
    "wide_char_share", "other_per_word",
)


def _set(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_SPACE, _SYMBOLS, _DIGITS = _set(" \t\n\x0b\x0c\r"), _set("#*$%&|<>"), _set("0123456789")
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_LEAD = np.r_[0:0x80, 0xC0:0x100]


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    # A pair gets a dense number first, so that no key overflows however many words there are.
    pair = np.unique(word[:-1] * len(ids) + word[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * np.int64(len(ids)) + word[2:], return_inverse=True, return_counts=True)
    first = np.flatnonzero(count[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[first + k] = True
    return int(covered.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of one text; every ratio of an empty text is zero."""
    data = text.encode()
    words = data.split()
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    spaces, chars = int(byte[_SPACE].sum()), int(byte[_LEAD].sum())
    symbols = int(byte[_SYMBOLS].sum())
    n = len(words)
    seen: set[bytes] = set()
    duplicates = filled = 0
    for line in data.split(b"\n"):
        if line.strip():
            filled += 1
            duplicates += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    inside = chars - spaces
    upper, lower = int(byte[_UPPER].sum()), int(byte[_LOWER].sum())
    wide, digits = int(byte[0xC0:].sum()), int(byte[_DIGITS].sum())
    share = lambda a, b: a / b if b else 0.0
    stops, marks, bars = int(byte[_set(".,;:")].sum()), int(byte[_set("!?")].sum()), int(byte[_set("|")].sum())
    other = inside - upper - lower - wide - digits - stops - marks - symbols
    return [n, inside, symbols, duplicates, repeats], [
        float(np.log1p(n)), share(inside, n), share(symbols, n), share(digits, inside), share(upper, upper + lower + wide),
        share(stops, n), share(marks, n), share(bars, n), share(duplicates, filled), share(repeats, n),
        share(len(set(words)), n), share(n, filled), share(sum([len(w) <= 3 for w in words]), n), share(wide, chars),
        share(other, n),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, _row``, the counts and ``features`` (array of double) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column("text")]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), *(pa.array(counts[:, k]) for k in range(len(COUNTS))),
                 pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                ["doc_id", "_row", *COUNTS, "features"],
            )

    longs = ", ".join(f"{c} long" for c in COUNTS)
    return identified(docs).mapInArrow(run, f"doc_id {kind}, _row long, {longs}, features array<double>")


def held_out() -> Column:
    """True for the third of all rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and ``quality`` of at most ``limit`` labelled rows that are not held out, chosen by a hash of their id.

    Rows without a label or with one other than 0 and 1 teach nothing; several labels of one id count by their maximum.
    Where there are more rows, a share that gives slightly fewer than ``limit`` is kept, so no task sends more than its
    part of them to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    labelled = stats.where(~held_out()).join(known, "doc_id").select("doc_id", "_row", "features", "quality")
    total = labelled.count()
    if total > limit:
        share = int((1 << 32) * 0.97 * limit / total)
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share).limit(limit)
    rows = sorted(labelled.collect(), key=lambda r: (r.doc_id, r["_row"]))
    x = np.array([r.features for r in rows], np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r.quality for r in rows], np.float64)


def with_statistics(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``statistics`` as a table, since fitting and scoring both read it."""
    return scratch.table(statistics(docs), "statistics")


def quality_labels(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", "quality")
