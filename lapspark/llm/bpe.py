"""Byte-pair encoding and decoding with word ends, over a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lapspark.llm.common import bare
from lapspark.llm.tokenizing import Memo, batches_of, by_special, specials, tokenizer

NONE = 1 << 30
#: Longer words take the heap, since rescanning the rank array is quadratic.
SHORT = 64
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Letters of UTF-8 outside ASCII only have bytes from 128 on; the alphabet shows 161-172 and 174-255 as themselves and
#: counts the hidden ones on from 256.
_BYTE_ALPHABET = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def _joined(parts: list[tuple[bytes, int, str]]) -> tuple[bytes, int, str]:
    return b"".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts if p[1]])


class WordBpe:
    """Encodes and decodes with a ``tokenizers`` file whose pre-tokenizer drops white space.

    The file's own normaliser and pre-tokenizer make the words; the merging and the decoding are done here.
    """

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tok = tokenizer(name)
        self.special = specials(self.tok)
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in chain(self.ids.items(), self.special.items())}
        self.words = Memo(lambda words: [self._told([self.ids[t] for t in self.merge(w) if t in self.ids]) for w in words])
        self.units = Memo(self._units, limit=500_000)

    def merge(self, word: str) -> list[str]:
        """The tokens of one pre-token.

        ``ranks[i]`` is the merge rank of ``parts`` i and i + 1. The leftmost smallest rank is merged in place, and only
        the two neighbouring ranks are looked up again.
        """
        if len(word) > SHORT:
            text = word + self.suffix
            return self._merge_long(text, [*range(len(word)), len(text)])
        if not word:
            return []
        rank = self.ranks.get
        parts = [*word]
        parts[-1] += self.suffix
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            whole = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((whole, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((parts[i - 1], whole), NONE)
        return parts

    def _merge_long(self, text: str, bounds: list[int]) -> list[str]:
        """The same merges with a heap over linked parts."""
        end = dict(zip(bounds, bounds[1:]))
        before = dict(zip(bounds[1:], bounds))
        rank = self.ranks.get

        def offer(i: int) -> None:
            j = end[i]
            if j in end and (r := rank((text[i:j], text[j:end[j]]))) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in bounds[:-1]:
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end.get(i) != j or end.get(j) != k:
                continue
            del end[j]
            end[i], before[k] = k, i
            offer(i)
            if i:
                offer(before[i])
        return [text[i:j] for i, j in sorted(end.items())]

    def _split(self, unit: str) -> list:
        """Words, in the byte alphabet, and ids of special strings."""
        plain = _PLAIN.fullmatch(unit)
        if plain:
            # Latin letters with stops behind: composed already, and no contraction to look for.
            word, stops = plain.groups()
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_ALPHABET)
            return [word, stops] if stops else [word]
        out: list = []
        for part in by_special(unit, self.special):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def _told(self, ids: list[int]) -> tuple[bytes, int, str]:
        """Packed ids, their number and the decoded text."""
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), self.decode(ids)

    def _units(self, units: list[bytes]) -> list[tuple[bytes, int, str]]:
        """Packed ids, their number and the decoded text of what stands between two white spaces."""
        split = [self._split(u.decode()) for u in units]
        known = self.words.prepare([w for words in split for w in words if isinstance(w, str)])
        out = []
        for words in split:
            parts = [known[w] if isinstance(w, str) else self._told([w]) for w in words]
            out.append(parts[0] if len(parts) == 1 else _joined(parts))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, their number, and what they decode to."""
        for some in batches_of(texts):
            # White space never joins a token, nor does normalisation compose across it.
            split = [text.encode().split() for text in some]
            known = self.units.prepare([u for units in split for u in units])
            for units in split:
                yield _joined([known[u] for u in units])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text]))[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """Tokens joined by spaces, as the library does for a file without a decoder; unknown ids are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_models: dict[str, WordBpe] = {}


def _model(name: str) -> WordBpe:
    if name not in _models:
        _models[name] = WordBpe(name)
    return _models[name]


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, ids, decoded`` for every row; a null text is empty, repeated rows repeat, no row gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in batches:
            out = list(model.encode_batch(batch.column("text").to_pylist()))
            ids = [np.frombuffer(b, "<u4").astype("i4") for b, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([t for _, _, t in out], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return bare(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row (see ``encode_documents``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in batches:
            n, ids, decoded = [], [], []
            for packed, count, text in model.encode_batch(batch.column("text").to_pylist()):
                n.append(count)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return bare(docs).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
