"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lapspark.llm.common import bare
from lapspark.llm.tokenizing import BYTE_ALPHABET, Memo, batches_of, by_special, space_units, specials, tokenizer

NONE = np.int64(1 << 40)
#: Letters or digits after at most one blank or line feed, and stops behind them: what the pattern cuts is plain here.
_PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+)([.,;:!?]*)")
_SPACE, _LINE_FEED = " \n".translate(BYTE_ALPHABET)


class MergeCounter:
    """Counts the tokens of byte-level BPE for many pre-tokens at once."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok = tokenizer(name)
        self.special = specials(self.tok)
        vocab, merges = model["vocab"], model["merges"]
        self.width = np.int64(len(vocab))
        pair = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair)
        self.pairs, self.rank_of = pair[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.byte_ids = np.zeros(0x400, np.int64)
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[ord(token)] = i
        self.words = Memo(self.count_words)
        self.units = Memo(self._units, limit=500_000)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of[at], NONE)

    def count_words(self, words: list[str], block: int = 2_000_000) -> list[int]:
        """Surviving symbols of each pre-token (written in the byte alphabet), ``block`` symbols at a time."""
        counts: list[int] = []
        start = size = 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= block:
                counts += self._count(words[start:i + 1])
                start, size = i + 1, 0
        return counts + (self._count(words[start:]) if start < len(words) else [])

    def _count(self, words: list[str]) -> list[int]:
        lengths = np.array([len(w) for w in words], np.int64)
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NONE
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(rank, starts)
            # A sequence without any pair left is finished.
            open_ = least < NONE
            counts[owner[starts[~open_]]] = sizes[~open_]
            keep = np.repeat(open_, sizes)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            if not len(symbols):
                break
            hit = rank == np.repeat(least[open_], sizes[open_])
            # In a run like "aaa" every other place merges, from the left.
            place = np.flatnonzero(hit)
            head = np.r_[True, np.diff(place) != 1]
            run = place[head][np.cumsum(head) - 1]
            place = place[(place - run) % 2 == 0]
            symbols[place] = self.result[rank[place]]
            gone = np.ones(len(symbols), bool)
            gone[place + 1] = False
            symbols, owner = symbols[gone], owner[gone]
        if len(symbols) == 1:
            counts[owner[0]] = 1
        return counts.tolist()

    def _split(self, unit: str) -> list[str]:
        """Pre-tokens of a unit, in the byte alphabet."""
        plain = _PLAIN.fullmatch(unit)
        if not plain:
            return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(unit)]
        blank, word, stops = plain.groups()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_ALPHABET)
        if blank == "\n":
            # A word takes a space before it, never a line feed.
            out = [_LINE_FEED, word]
        else:
            out = [_SPACE + word if blank else word]
        if stops:
            out.append(stops)
        return out

    def _units(self, units: list[str]) -> list[int]:
        words = [self._split(u) for u in units]
        known = self.words.prepare([w for ws in words for w in ws])
        return [sum(known[w] for w in ws) for ws in words]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for some in batches_of(texts):
            parts = [by_special(t, self.special) for t in some]
            units = [[u for p in ps if p not in self.special for u in space_units(p)] for ps in parts]
            known = self.units.prepare([u for us in units for u in us])
            out += [
                sum([known[u] for u in us]) + sum([p in self.special for p in ps]) for ps, us in zip(parts, units)
            ]
        return out


_counters: dict[str, MergeCounter] = {}


def _counter(name: str) -> MergeCounter:
    if name not in _counters:
        _counters[name] = MergeCounter(name)
    return _counters[name]


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; a null text is empty, repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in batches:
            text = batch.column("text")
            n = pa.array(counter.count(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return bare(docs).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
