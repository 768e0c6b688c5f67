"""Suffix, sentence and SimHash de-duplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lapspark.llm import sentence_spans, simhash, suffix_dedup
from lapspark.llm.common import Scratch


def removed(texts, length):
    """Per text the kept bytes, the number of removed ones and of removed runs."""
    count = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield bytes(b for b, g in zip(t, gone) if not g), sum(gone), runs


def mixed_texts(rnd, length):
    texts = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 700))) for _ in range(25)]
    for _ in range(45):
        a, b = rnd.choice(texts), rnd.choice(texts)
        i, k = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        x = b[:k] + a[i:i + rnd.randint(0, 4 * length)] + b[k:]
        if x and rnd.random() < 0.5:
            q = rnd.randrange(len(x))
            x = x[:q] + "Z" + x[q + 1:]
        texts.append(x[:2500])
    return [*texts, "a" * 300, "ab" * 200, "a" * length, "b" * length, "b" * length, "x" * (length - 1), "", None]


@pytest.mark.parametrize("length", [40, 64, 250])
def test_repeated_bytes(make_docs, length):
    texts = mixed_texts(random.Random(length), length)
    want = list(removed([(t or "").encode() for t in texts], length))
    got = {r.doc_id: r for r in suffix_dedup.removal_digest(make_docs(texts).repartition(5), length).collect()}
    assert len(got) == len(texts) and sum(w[1] for w in want) > 5_000
    for i, (kept, n, runs) in enumerate(want):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, runs, hashlib.sha256(kept).hexdigest()), i


def test_production_length(make_docs):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    passage = text(1000)
    texts = [text(900) + passage + text(700), passage[:399] + text(50), text(30) + passage[200:800], text(3000)]
    texts += ["q" + passage[:400], texts[3], None, "é" * 300]
    want = list(removed([(t or "").encode() for t in texts], 400))
    got = {r.doc_id: r for r in suffix_dedup.removal_digest(make_docs(texts)).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(len(texts))] == [w[1:] for w in want]


def test_slabs_do_not_show(monkeypatch):
    rnd = random.Random(4)
    texts = [("".join(rnd.choice("ab") for _ in range(5000)) + "c" * 700).encode() for _ in range(3)]
    whole = suffix_dedup.anchors(texts, 64)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 300)
    cut = suffix_dedup.anchors(texts, 64)
    assert all(np.array_equal(whole[k], cut[k]) for k in whole)


def test_repeated_rows_and_null_ids(spark):
    a, b = "x1" * 40 + "end", "y2z" * 40
    df = spark.createDataFrame([(1, a), (1, a), (None, b), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.removal_digest(df, 40).collect())
    assert got == [(0, 120), (1, 83), (1, 83), (2, 0)]


def test_cleaned_documents_keep_their_columns(make_docs, odd_texts):
    docs = make_docs(odd_texts)
    for operator in (suffix_dedup.remove_repeats, sentence_spans.remove_later_spans):
        out = operator(docs)
        assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == len(odd_texts) and rows[0].text is None
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows.values())
    assert {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}[4].text == ""


def test_sentence_spans(make_docs):
    s = [f"Sentence number {k} here." for k in range(12)]
    texts = [
        " ".join(s[:6]), "Own start. " + " ".join(s[1:5]) + " Own end.", " ".join(s[2:4]) + " Third.",
        "One two.", "One two.", "\n\n", None, " ".join(s[6:9]) + "\n" + " ".join(s[6:9]),
    ]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in sentence_spans.sentence_digest(make_docs(texts)).collect()}
    assert got == {0: (6, 0), 1: (6, 4), 2: (3, 0), 3: (1, 0), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (6, 3)}
    kept = {r.doc_id: r.text for r in sentence_spans.remove_later_spans(make_docs(texts)).collect()}
    assert kept[1] == "Own start. Own end." and kept[4] == "" and kept[6] is None and kept[0] == texts[0]


def simple_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(fps, errors=4):
    f = np.array(fps, np.uint64)
    linked = np.bitwise_count(f[:, None] ^ f[None, :]) <= errors
    label = np.arange(len(f))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_components(make_docs, odd_texts):
    rnd = random.Random(9)
    base = " ".join(rnd.choice("alpha Beta gamma delta eps zeta".split()) + str(rnd.randint(0, 99)) for _ in range(400))
    near = [base.replace(base.split()[k], "changed", 1) for k in (5, 50, 200)]
    texts = [base, *odd_texts, *near, base]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.fingerprint_digest(make_docs(texts, first=10)).collect()}
    fps = [simple_fingerprint(t or "") for t in texts]
    want = smallest_reachable(fps)
    assert got == {10 + i: (f"{fp:016x}", 10 + int(c)) for i, (fp, c) in enumerate(zip(fps, want))}


def test_links_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 40)
    monkeypatch.setattr(simhash, "FRONTIER", 100)
    rnd = random.Random(3)
    fps = {rnd.getrandbits(9) for _ in range(200)}
    for center in [rnd.getrandbits(64) for _ in range(8)]:
        for _ in range(40):
            x = center
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "node long, fp0 long"), simhash.exact_masks(4), 4)
    root = {r.node: r.root for r in simhash.components(edges, Scratch(spark)).collect()}
    want = smallest_reachable(fps)
    assert [root.get(x, x) for x in signed] == [signed[c] for c in want]


def test_one_of_each_group_stays(make_docs):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(300))
    clean = [text() for _ in range(40)]
    copies = [" ".join("edit" if k in (17, 140) else w for k, w in enumerate(t.split())) for t in clean[:10]]
    docs = make_docs([*clean, *copies, clean[3], None, ""])
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [*range(40), 51]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(-20, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, Scratch(spark)).collect()}
    assert got == {**{k: -20 for k in range(-19, 41)}, 101: 100}


@pytest.mark.parametrize("operator", [
    suffix_dedup.removal_digest, suffix_dedup.remove_repeats, sentence_spans.sentence_digest,
    sentence_spans.remove_later_spans, simhash.fingerprint_digest, simhash.keep_one_of_each,
])
def test_empty_table(make_docs, operator):
    assert operator(make_docs(["x"]).limit(0)).collect() == []
