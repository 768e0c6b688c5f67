"""Removal of repeated byte strings by refining suffix buckets.

Two start positions belong together when the strings of ``length`` bytes there are equal. As in bucket-pointer
refinement, positions get bucket identifiers for short prefixes first; the identifier of a prefix twice as long is made
from two identifiers at an offset, so each level reuses the one below. Identifiers are 64-bit hashes of these pairs
instead of ranks, which makes them the same in every task: Spark groups on them, and no task needs the whole text.

Three levels keep what is shuffled far below one row per byte:

1. Of all prefixes of ``q`` bytes inside a string, the one with the smallest identifier is its anchor: equal strings
   have equal anchors at equal distances, and about one position in 140 is one. An anchor's bucket is its q-gram, and
   its context is everything any string around it covers. Equal contexts settle all their strings with one row each.
2. Buckets with different contexts are refined: one row for each distinct context and each chunk of start positions,
   bucketed by what the strings of a chunk have in common, and settled where whole chunks are equal.
3. What is left (the edges of repeated passages) is refined to single start positions.

Any count uses at least two independent 64-bit identifiers (anchor and context, or anchor and string). Groups are
counted with map-side combining and flags return through equi-joins, which adaptive execution splits when skewed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, carried, identified, join_rows, restored
from lapspark.operators.joins import join_per_key

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes named together; longer documents are cut into slabs that overlap.
BUFFER = 1 << 19


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x ^= x >> np.uint64(32)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


class Names:
    """Bucket identifiers of all prefixes of q and 2q bytes in a buffer."""

    def __init__(self, data: np.ndarray, q: int):
        self.q = q
        name = data.astype(np.uint64)
        for size in (1, 2, 4):  # up to eight bytes the identifier is the string itself
            name = name[:-size] | name[size:] << np.uint64(8 * size)
        size = 8
        while size < q:
            name = _mix(name[:-size], name[size:])
            size *= 2
        self.single = name
        self.double = _mix(name[:-q], name[q:])

    def cover(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identifiers of the strings [start, end), 2q to 10q bytes long."""
        x = self.double[start]
        for k in range(1, 5):
            x = _mix(x, self.double[np.minimum(start + 2 * self.q * k, end - 2 * self.q)])
        return _mix(x, (end - start).astype(np.uint64))


def gram_size(length: int) -> int:
    """The largest power of two up to two fifths of ``length``."""
    return 1 << (int(length * 0.4).bit_length() - 1)


def _chunk(length: int) -> int:
    return min(32, length // 8)


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Runs of ``(document, first byte, first start, end of starts, bytes)`` that fit one buffer."""
    some, size = [], 0
    for i, text in enumerate(texts):
        last = len(text) - length + 1
        for p in range(0, max(0, last), BUFFER):
            stop = min(last, p + BUFFER)
            begin = max(0, p - length)
            some.append((i, begin, p, stop, text[begin:stop + 2 * length]))
            size += len(some[-1][4])
            if size >= BUFFER:
                yield some
                some, size = [], 0
    if some:
        yield some


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Anchors of all texts: document, place, the starts ``lo..hi`` of the strings they stand for, q-gram, context."""
    q = gram_size(length)
    width = length - q + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "at", "lo", "hi", "gram", "context")}
    mask = np.uint64((1 << 21) - 1)
    for some in _segments(texts, length):
        data = np.frombuffer(b"".join(s[4] for s in some), np.uint8)
        names = Names(data, q)
        place = np.arange(len(names.single), dtype=np.uint64)
        # The low bits hold the place, so the leftmost of equal identifiers wins, whatever stands around.
        chosen = (_least(names.single & ~mask | place, width) & mask).astype(np.int64)
        begins = np.cumsum([0, *(len(s[4]) for s in some)])[:-1]
        for begin, (i, base, first, stop, _) in zip(begins, some):
            a = chosen[begin + first - base:begin + stop - base] - begin + base
            new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            at = a[new]
            lo = first + new
            hi = first + np.r_[new[1:], len(a)] - 1
            left = np.maximum(at - (length - q), 0)
            right = np.minimum(at + length, sizes[i])
            shift = begin - base
            context = _mix(names.cover(left + shift, right + shift), ((at - left) * 4096 + right - at).astype(np.uint64))
            for k, v in zip(parts, (np.full(len(at), i), at, lo, hi, names.single[at + shift], context)):
                parts[k].append(v)
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}
    # An anchor whose starts were cut between two slabs is one anchor.
    first = np.flatnonzero(np.r_[True, (np.diff(out["doc"]) != 0) | (np.diff(out["at"]) != 0)][:len(out["doc"])])
    out["hi"] = out["hi"][np.r_[first[1:], len(out["doc"])] - 1] if len(first) else out["hi"]
    return {k: v if k == "hi" else v[first] for k, v in out.items()}


def _cut(text: bytes, at: int, length: int, q: int) -> tuple[int, bytes]:
    begin = max(0, at - (length - q))
    return begin, text[begin:at + length]


def chunks(items: list[tuple[bytes, int, int, int]], length: int) -> dict[str, np.ndarray]:
    """Chunks of ``(text, at, lo, hi)``: item, number, own starts ``lo..hi``, common core and whole span."""
    q, c = gram_size(length), _chunk(length)
    cuts = [_cut(t, at, length, q) for t, at, _, _ in items]
    names = Names(np.frombuffer(b"".join(b for _, b in cuts), np.uint8), q)
    begin = np.cumsum([0, *(len(b) for _, b in cuts)])[:-1] - np.array([b for b, _ in cuts])
    at, lo, hi = (np.array([x[k] for x in items], np.int64) for k in (1, 2, 3))
    size = np.array([len(x[0]) for x in items], np.int64)
    first, last = (at - hi) // c, (at - lo) // c
    item = np.repeat(np.arange(len(items)), last - first + 1)
    number = np.arange(len(item)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[item]
    high = at[item] - c * number
    low = high - c + 1
    shift = begin[item]
    core = names.cover(high + shift, low + length + shift)
    # The left context of an anchor ends length - q before it, wherever its document begins.
    left = np.maximum(low, np.maximum(at[item] - (length - q), 0))
    right = np.minimum(np.minimum(high, at[item]) + length, size[item])
    span = _mix(names.cover(left + shift, right + shift), ((high - left) * 4096 + right - high).astype(np.uint64))
    return {"item": item, "number": number, "lo": np.maximum(low, lo[item]), "hi": np.minimum(high, hi[item]),
            "core": core, "span": span}


def strings(items: list[tuple[bytes, int, int, int]], length: int) -> dict[str, np.ndarray]:
    """Every single start ``lo..hi`` of ``(text, at, lo, hi)`` with the identifier of its string."""
    q = gram_size(length)
    cuts = [(lo, t[lo:hi + length]) for t, _, lo, hi in items]
    names = Names(np.frombuffer(b"".join(b for _, b in cuts), np.uint8), q)
    begin = np.cumsum([0, *(len(b) for _, b in cuts)])[:-1]
    count = np.array([hi - lo + 1 for _, _, lo, hi in items], np.int64)
    item = np.repeat(np.arange(len(items)), count)
    start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.array([x[2] for x in items], np.int64)
    return {"item": item, "lo": start - begin[item] + lo[item], "string": names.cover(start, start + length)}


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _anchor_rows(docs: DataFrame, kind: str, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anchors(batch.column("text").cast(pa.binary()).to_pylist(), length)
            doc = pa.array(found["doc"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(doc), batch.column("_row").take(doc),
                 *(pa.array(found[k], pa.int64()) for k in ("at", "lo", "hi")),
                 _signed(found["gram"]), _signed(found["context"])],
                ["doc_id", "_row", "at", "lo", "hi", "gram", "name"],
            )

    return docs.select("doc_id", "_row", "text").mapInArrow(
        run, f"doc_id {kind}, _row long, at long, lo long, hi long, gram long, name long")


def _refined(docs: DataFrame, items: DataFrame, kind: str, length: int, single: bool) -> DataFrame:
    """Rows of the next level for ``items`` (``doc_id, _row, gram, at, lo, hi``), read from the texts again."""
    listed = items.groupBy("_row", "doc_id").agg(F.collect_list(F.struct("gram", "at", "lo", "hi")).alias("items"))
    wanted = join_rows(docs.select("doc_id", "_row", "text"), listed, "inner")

    def rows(batch: pa.RecordBatch, some: list) -> pa.RecordBatch:
        work = [x[1:] for x in some]
        found = strings(work, length) if single else chunks(work, length)
        doc = pa.array(np.array([x[0][0] for x in some])[found["item"]])
        gram = np.array([x[0][1] for x in some], np.int64)[found["item"]]
        at = np.array([x[1] for x in work], np.int64)[found["item"]]
        lo = found["lo"]
        extra = [pa.array(gram), _signed(found["string"])] if single else [
            pa.array(gram), _signed(_mix(found["core"], found["number"].astype(np.uint64))), _signed(found["span"])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(doc), batch.column("_row").take(doc), pa.array(at), pa.array(lo),
             pa.array(lo if single else found["hi"]), *extra],
            ["doc_id", "_row", "at", "lo", "hi", "gram", *(["name"] if single else ["core", "name"])],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            texts = batch.column("text").cast(pa.binary())
            for i, listed in enumerate(batch.column("items").to_pylist()):
                text = texts[i].as_py()
                for x in listed:
                    some.append(((i, x["gram"]), text, x["at"], x["lo"], x["hi"]))
                    size += 2 * length
                    if size >= BUFFER:
                        yield rows(batch, some)
                        some, size = [], 0
            if some:
                yield rows(batch, some)

    core = "" if single else "core long, "
    return wanted.mapInArrow(
        run, f"doc_id {kind}, _row long, at long, lo long, hi long, gram long, {core}name long")


def _settled(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """Rows whose name occurs more than once in their bucket."""
    again = rows.groupBy(*bucket, "name").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return join_per_key(rows, again, [*bucket, "name"], "left_semi").select("doc_id", "_row", "lo", "hi")


def _open(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """One row for each name in buckets that hold several names."""
    first = rows.groupBy(*bucket, "name").agg(F.min(F.struct("_row", "doc_id", "at", "lo", "hi")).alias("_first"))
    several = first.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return join_per_key(first, several, bucket, "left_semi").select("gram", "_first.*")


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, _row, lo, hi``: all starts lo..hi of a string of ``length`` bytes that also starts elsewhere.

    ``docs`` is ``identified``. Everything but the answer is removed from the shared folder before this returns.
    """
    kind = dict(docs.dtypes)["doc_id"]
    scratch, answer = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    level1 = scratch.table(_anchor_rows(docs, kind, length), "anchors")
    open1 = scratch.table(_open(level1, ["gram"]), "contexts")
    level2 = scratch.table(_refined(docs, open1, kind, length, single=False), "chunks")
    open2 = _open(level2, ["gram", "core"])
    level3 = scratch.table(_refined(docs, open2, kind, length, single=True), "strings")
    starts = (
        _settled(level1, ["gram"]).unionByName(_settled(level2, ["gram", "core"])).unionByName(_settled(level3, ["gram"]))
    )
    found = answer.table(starts, "starts")
    scratch.drop()
    return found


def _bytes_kept(text: bytes, starts: list[dict] | None, length: int) -> tuple[bytes, int]:
    """What is left of a text, and how many runs were removed."""
    if not starts:
        return text, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, [s["lo"] for s in starts], 1)
    np.add.at(edge, [s["hi"] + length for s in starts], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def _with_starts(docs: DataFrame, length: int) -> DataFrame:
    listed = repeated_starts(docs, length).groupBy("_row", "doc_id").agg(
        F.collect_set(F.struct("lo", "hi")).alias("_starts"))
    return join_rows(docs, listed)


def removal_digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null text is empty; texts under ``length`` bytes keep all; of repeated rows each is a place of its own, so both lose
    all repeated bytes; an empty table gives no rows; ids may be null and other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digest = [], [], [], []
            texts = batch.column("text").cast(pa.binary())
            for text, starts in zip(texts.to_pylist(), batch.column("_starts").to_pylist()):
                kept, runs = _bytes_kept(text, starts, length)
                n.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(runs)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, removed, spans)), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_starts(identified(docs), length).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_WORD = re.compile(rb"\S+")


def _short_windows(docs: DataFrame, kind: str, length: int, words: int) -> DataFrame:
    """Every run of ``words`` words under ``length`` bytes: ``doc_id, _row, lo, hi`` (its bytes) and a 128-bit name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                places = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
                if len(places) < words:
                    continue
                lo, hi = places[:len(places) - words + 1, 0], places[words - 1:, 1]
                short = hi - lo < length
                lo, hi = lo[short], hi[short]
                if not len(lo):
                    continue
                digest = [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(lo.tolist(), hi.tolist())]
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                doc = pa.array(np.full(len(lo), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("_row").take(doc), pa.array(lo), pa.array(hi),
                     *(pa.array(np.ascontiguousarray(h)) for h in halves.T)],
                    ["doc_id", "_row", "lo", "hi", "h1", "h2"])

    return docs.select("doc_id", "_row", "text").mapInArrow(
        run, f"doc_id {kind}, _row long, lo long, hi long, h1 long, h2 long")


def repeated_windows(docs: DataFrame, length: int, words: int) -> DataFrame:
    """``doc_id, _row, lo, hi``: bytes of all runs of ``words`` words under ``length`` bytes that also stand elsewhere."""
    scratch, answer = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = scratch.table(_short_windows(docs, dict(docs.dtypes)["doc_id"], length, words), "windows")
    again = rows.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = answer.table(
        join_per_key(rows, again, ["h1", "h2"], "left_semi").select("doc_id", "_row", "lo", "hi"), "repeated-windows")
    scratch.drop()
    return found


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` without the repeated bytes of its texts; a character that loses a byte goes whole.

    With ``words``, runs of so many words that also stand elsewhere go too, however short the words are. Other columns stay; ``n_chars``, if there, follows the text. A null text stays null.
    """
    known = identified(docs)
    found = repeated_starts(known, length)
    if words:
        # A window is bytes, not starts: as starts of strings of ``length`` bytes it ends ``length`` before.
        short = repeated_windows(known, length, words)
        found = found.unionByName(short.withColumn("hi", F.col("hi") - length))
    listed = found.groupBy("_row", "doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("_starts"))
    joined = join_rows(carried(docs), listed).select("text", "_starts", "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text")
            for i, starts in enumerate(batch.column("_starts").to_pylist()):
                text = texts[i].as_py()
                if starts and text:
                    text = _bytes_kept(text.encode(), starts, length)[0].decode("utf-8", "ignore")
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("_doc")], ["text", "_doc"])

    kept = joined.select("text", "_doc").schema
    return restored(joined.mapInArrow(run, kept), docs, fresh_size=True)
