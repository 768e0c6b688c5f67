"""Document statistics against brute force, held-out accuracy of both models, and monotonicity."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from lapspark.llm import doc_stats, quality_gam, quality_gbt
from lapspark.llm.common import read

SF = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if count[window] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(repeated)]


def test_base_statistics(make_docs, odd_texts, spark):
    rnd = random.Random(6)
    texts = odd_texts + ["".join(rnd.choice(["a", "b ", "\n", "é", "#", " | ", "a b c\n", "\x0b", "\x1c"]) for _ in range(rnd.randint(0, 80)))
                         for _ in range(300)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_gbt.judge(make_docs(texts), labels).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        assert [got[i][c] for c in doc_stats.COUNTS] == want, repr(t)[:200]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed) and got[i].score == 0.5


@pytest.fixture(scope="module")
def held_out_labels(spark):
    return {r.doc_id: r.quality for r in read(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_classifier_on_held_out_rows(spark, held_out_labels):
    docs, labels = read(spark, SF, "documents"), doc_stats.quality_labels(spark, SF)
    rows = {r.doc_id: r for r in quality_gam.score_quality(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    hits = [rows[i].predicted == q for i, q in held_out_labels.items()]
    assert np.mean(hits) >= 0.97
    kept = {r.doc_id for r in quality_gam.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = read(spark, SF, "documents")
    labels = doc_stats.quality_labels(spark, SF).cache()
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    scores = lambda y: {r.doc_id: r.score for r in quality_gam.score_quality(docs, y).collect()}
    assert scores(labels) == scores(flipped)


def test_rules_on_held_out_rows(spark, held_out_labels):
    rows = {r.doc_id: r for r in quality_gbt.judge(read(spark, SF, "documents"), doc_stats.quality_labels(spark, SF)).collect()}
    judged = [(rows[i].kept, q) for i, q in held_out_labels.items() if not rows[i].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) >= 0.97


def test_forest_is_monotone():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, len(doc_stats.FEATURES)))
    bad = doc_stats.FEATURES.index("symbols_per_word")
    y = (x[:, bad] + 0.3 * rnd.random(3000) + 0.3 * x[:, 0] < 0.7).astype(float)
    y[rnd.random(3000) < 0.1] = 1
    forest = quality_gbt.fit(x, y)
    assert np.mean((forest.score(x) >= 0.5) == (y == 1)) > 0.85
    for row in x[:50]:
        line = np.repeat(row[None], 40, axis=0)
        line[:, bad] = np.linspace(0, 1.2, 40)
        assert (np.diff(forest.score(line)) <= 1e-12).all()


def test_pairs_are_learned():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)) > 0.9


def test_empty_tables_and_one_class(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    docs = make_docs(["a b", None, ""])
    for operator in (quality_gam.score_quality, quality_gbt.judge):
        assert operator(docs.limit(0), ones).collect() == []
        assert [r.score for r in operator(docs, none).collect()] == [0.5] * 3
        assert all(r.score > 0.5 for r in operator(docs, ones).collect())
    out = quality_gam.keep_good(docs, ones)
    assert out.columns == docs.columns and out.count() == 3


def test_training_sample_is_bounded_and_stable(spark):
    from lapspark.llm.common import Scratch

    stats = doc_stats.with_statistics(read(spark, SF, "documents"), Scratch(spark))
    labels = doc_stats.quality_labels(spark, SF)
    whole = doc_stats.training_rows(stats, labels, 10_000)
    some = doc_stats.training_rows(stats, labels, 100)
    again = doc_stats.training_rows(stats.repartition(3), labels, 100)
    assert len(whole[1]) == len(labels.where("crc32(cast(doc_id as string)) % 3 <> 1").collect())
    assert 60 < len(some[1]) <= 100 and all(np.array_equal(a, b) for a, b in zip(some, again))
