"""BPE encoding, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapspark.llm import bpe, packing, token_count
from lapspark.llm.tokenizing import space_units, tokenizer

ALPHABET = " \n\t\r\x0b\x0c\x1c\x85\xa0 　abcABCtheing'sll012é̈ÀΣσßİı日😀<|>-_.,!?​"


@pytest.fixture(scope="module")
def texts(odd_texts):
    rnd = random.Random(1)
    parts = ["the", " ", "\n", "<|endoftext|>", "ing", "  ", "\n\n", " a", "'s", "É"]
    return (
        odd_texts + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
        + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    )


def test_bpe_equals_library(make_docs, texts):
    tok = tokenizer("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.encoding_digest(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest(), repr(t)


def test_bpe_decodes_a_word_once(monkeypatch):
    """Units of known words and stops are put together from what the words gave."""
    model, calls = bpe.WordBpe("word_bpe_49k.json"), []
    decode = model.decode
    monkeypatch.setattr(model, "decode", lambda ids: calls.append(1) or decode(ids))
    (packed, n, text), = model.encode_batch(["abc abc, abc. Éa Éa, Éa. abc! Éa!"])
    want = model.tok.encode("abc abc, abc. Éa Éa, Éa. abc! Éa!", add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == want and n == len(want) and text == decode(want)
    assert len(calls) == 5


def test_bpe_rows_and_round_trip(make_docs):
    rows = bpe.encode_documents(make_docs(["hello  world", None])).orderBy("doc_id").collect()
    assert rows[1].ids == [] and rows[1].decoded == ""
    model = bpe.WordBpe("word_bpe_49k.json")
    assert model.encode("hello  world") == rows[0].ids
    assert model.decode(rows[0].ids) == rows[0].decoded == "hello</w> world</w>"


def test_long_words_take_the_heap():
    model = bpe.WordBpe("word_bpe_49k.json")
    rnd = random.Random(2)
    for n in (65, 200, 900):
        word = "".join(rnd.choice("abehint") for _ in range(n))
        assert model.encode(word) == tokenizer("word_bpe_49k.json").encode(word, add_special_tokens=False).ids


def test_counts_equal_library(make_docs, texts):
    tok = tokenizer("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_count.count_tokens(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)


def test_units_join_to_the_text(texts):
    assert all("".join(space_units(t)) == t for t in texts if t is not None)


def test_packing_places_every_id_once(make_docs, texts):
    tok = tokenizer("byte_bpe_50k.json")
    rows = packing.pack_documents(make_docs(texts), window=256, shard_rows=200).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for i, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * total / 256 + 4


def test_packing_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert sorted(r.offset for r in rows) == [0, 3, 6, 8] and len({r.sequence_id for r in rows}) == 1


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "timestamp", "binary", "struct<a:int,b:string>"])
def test_packing_takes_ids_of_any_type(spark, kind):
    texts = ["some words here " * (k % 7) for k in range(40)]
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ident = {
        "struct<a:int,b:string>": F.struct(F.col("doc_id").cast("int").alias("a"), F.lit("x").alias("b")),
        "binary": F.col("doc_id").cast("string").cast("binary"), "timestamp": F.timestamp_seconds("doc_id"),
    }.get(kind, F.col("doc_id").cast(kind))
    df = whole.withColumn("doc_id", F.when(F.col("doc_id") > 2, ident))
    packed = packing.pack_documents(df, window=64)
    assert dict(packed.dtypes)["doc_id"] == kind
    rows = packed.collect()
    assert len({r.doc_id for r in rows if r.doc_id is not None}) == 37
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (seq, at, length), (other, later, _) in zip(places, places[1:]):
        assert later == (at + length if seq == other else 0)


def test_minimum_bin_slack_fills_exactly():
    best = packing.fill({700: 1, 600: 2, 300: 5}, 1500)
    assert sum(v * c for v, c in best) == 1500
    rnd = random.Random(3)
    for _ in range(50):
        counts = {rnd.randint(1, 60): rnd.randint(1, 3) for _ in range(rnd.randint(0, 6))}
        capacity = rnd.randint(1, 120)
        sums = {0}
        for v, c in counts.items():
            sums = {s + v * k for s in sums for k in range(c + 1)}
        got = packing.fill(counts, capacity)
        assert sum(v * c for v, c in got) == max(s for s in sums if s <= capacity)
        assert all(c <= counts[v] for v, c in got)


@pytest.mark.parametrize("operator", [bpe.encoding_digest, bpe.encode_documents, token_count.count_tokens, packing.pack_documents])
def test_empty_table(make_docs, operator):
    assert operator(make_docs(["x"]).limit(0)).collect() == []
