"""Packing token sequences into windows by minimum bin slack.

Documents are tokenised and cut at multiples of the window; what remains of each is shorter than a window. Remainders
meet in shards of a bounded number of rows. A shard opens a window with its longest remainder and lets a subset-sum over
a bitset pick, from the multiset of remaining lengths, the filling closest to capacity; the counts come from walking the
bitsets back. One pattern serves as many windows as its lengths allow.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, identified
from lapspark.llm.tokenizing import specials, tokenizer


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts for a byte-level ``tokenizers`` file.

    Where token ids are in the order of the merges, the same merging by rank runs on the file's vocabulary without the
    offsets that the tokenizers library keeps, in a quarter of its time. Texts that it cannot take (very long runs of
    white space) and other files are encoded by the library.
    """

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok = tokenizer(name)
        byte, vocab = _byte_alphabet(), model["vocab"]
        merged = [vocab[a + b] for a, b in model["merges"]]
        self.fast = None
        if merged == sorted(merged):
            self.fast = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, special_tokens=specials(self.tok),
                mergeable_ranks={bytes(byte[c] for c in token): i for token, i in vocab.items()})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut_pieces(docs: DataFrame, name: str, window: int, end_id: int) -> DataFrame:
    """``doc_id, _row, _nth, start, length, ids_crc32, doc_tokens``: every document's ids and ``end_id``, cut at ``window``."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        seen = 0
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encoder.encode(text.as_py()), end_id).astype("<u4")
                n = len(ids)
                for s in range(0, n, window):
                    at.append(i)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(zlib.crc32(ids[s:s + window].tobytes()))
                    total.append(n)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_row").take(at), pc.add(at, seen),
                 *(pa.array(v, pa.int64()) for v in (start, length, crc, total))],
                ["doc_id", "_row", "_nth", "start", "length", "ids_crc32", "doc_tokens"],
            )
            seen += batch.num_rows

    return identified(docs).mapInArrow(
        run, f"doc_id {kind}, _row long, _nth long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset ``(length, how many)`` with the largest sum up to ``capacity``; ``counts`` has what remains.

    Bit s of a bitset says that s can be reached. Lengths come from the longest; the search ends when the capacity
    itself is reachable. Counts are entered in powers of two, so a length with many copies takes few steps.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((v for v in counts if v <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for earlier, length, copies in reversed(steps):
        if not earlier >> total & 1:
            taken[length] = taken.get(length, 0) + copies
            total -= length * copies
    return sorted(taken.items(), reverse=True)


def minimum_bin_slack(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of indices into ``lengths``; every index is in exactly one."""
    of: dict[int, list[int]] = {}
    for i, v in enumerate(lengths):
        of.setdefault(v, []).append(i)
    counts = {v: len(x) for v, x in of.items()}
    windows = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = dict(fill({v: c for v, c in counts.items() if c}, window - longest))
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[v] // c for v, c in pattern.items())
        for _ in range(times):
            windows.append([of[v].pop() for v, c in pattern.items() for _ in range(c)])
        for v, c in pattern.items():
            counts[v] -= c * times
            if not counts[v]:
                del counts[v]
    return windows


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", window: int = 2048, end_id: int = 1,
                   shard_rows: int = 20_000) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the single id ``end_id``; repeated rows are packed as often as they occur; an empty table
    gives no rows. A piece's shard is a hash of its row, its start and its place in the task that cut it (so copies of
    one row spread as well); the number of shards follows the number of pieces. The cut pieces are written before they
    are packed, so a repeated task packs the same pieces.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.table(cut_pieces(docs, name, window, end_id), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    kind = dict(docs.dtypes)["doc_id"]
    # Ids that are no integers are put in order by their hash.
    order_id = F.col("doc_id") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("doc_id")
    spread = pieces.withColumns({
        "_shard": F.pmod(F.xxhash64("_row", "doc_id", "start", "_nth"), F.lit(shards)), "_order": order_id})

    def pack(table: pa.Table) -> pa.Table:
        length, start, row, doc = (
            table.column(c).fill_null(-1).to_numpy() for c in ("length", "start", "_row", "_order"))
        order = np.lexsort((start, row, doc, length))
        table, length = table.take(pa.array(order)), length[order]
        whole = np.flatnonzero(length == window)
        rest = np.flatnonzero(length < window)
        sequence = np.zeros(len(length), np.int64)
        offset = np.zeros(len(length), np.int64)
        first = table.column("_shard")[0].as_py() << 32
        # Whole windows need no packing, but their numbers come from the same shard.
        sequence[whole] = first + np.arange(len(whole))
        for k, members in enumerate(minimum_bin_slack(length[rest].tolist(), window), first + len(whole)):
            at = rest[members]
            sequence[at] = k
            offset[at] = np.cumsum(length[at]) - length[at]
        return (
            table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            .append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
        )

    return spread.groupBy("_shard").applyInArrow(
        pack,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
