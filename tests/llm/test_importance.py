import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lapspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéB0") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def naive_features(text):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(found[i:i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]
    return len(found), Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def expected(docs, target, percent=5):
    known = [(i, *naive_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in known:
        s += f
    for text in target:
        t += naive_features(text)[1]
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in known:
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b, c in f.items())
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    long_enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(long_enough[:percent * len(long_enough) // 100])}
    return sorted([(r[0], *r[2:], ranks.get(id(r))) for r in rows], key=repr)


def found(make_docs, spark, docs, target, percent=5):
    frame = make_docs([t for _, t in docs]).drop("doc_id")
    rows = [(i, *r) for (i, _), r in zip(docs, frame.collect())]
    frame = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} {k}" for c, k in frame.dtypes))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = importance.resample(frame, texts, percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_counting_strings(spark, make_docs, odd_texts):
    rnd = random.Random(3)
    docs = list(enumerate([*odd_texts, *(words(rnd, rnd.randint(0, 90)) for _ in range(150))]))
    docs += [(None, words(rnd, 30)), (7, words(rnd, 25)), (docs[30][0], docs[30][1])]
    target = [words(rnd, 40) for _ in range(5)] + [None, ""]
    for percent in (5, 60):
        assert found(make_docs, spark, docs, target, percent) == expected(docs, target, percent)


def test_small_buffers_cut_nothing(monkeypatch, odd_texts):
    rnd = random.Random(4)
    texts = [(t or "").encode() for t in [*odd_texts, *(words(rnd, 200) for _ in range(10))]]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(importance, "BUFFER", size)
        n, per_doc = np.zeros(len(texts), np.int64), [Counter() for _ in texts]
        for word_doc, doc, bucket in importance.features(texts):
            np.add.at(n, word_doc, 1)
            for d, b in zip(doc.tolist(), bucket.tolist()):
                per_doc[d][b] += 1
        assert [(k, c) for k, c in zip(n.tolist(), per_doc)] == [naive_features(t.decode()) for t in texts]


@pytest.mark.parametrize("length", [1, 2, 5, 64, 65, 300])
def test_shifted_checksums(length):
    a, b = b"lap", bytes(k % 251 for k in range(length))
    joined = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([length])) ^ np.uint32(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(a + b)


def test_empty_tables(spark, make_docs):
    assert found(make_docs, spark, [], ["a b"]) == []
    docs = [(i, "one two three " * 8) for i in range(40)]
    assert found(make_docs, spark, docs, []) == expected(docs, [])


def test_drawn_rows(spark, make_docs):
    docs = make_docs([f"word{i} other " * 15 for i in range(100)])
    target = spark.createDataFrame([(0, "word17 other")], "item_id long, text string")
    got = importance.drawn(docs, target)
    assert got.columns == docs.columns and got.count() == 5
