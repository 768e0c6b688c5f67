import random

import numpy as np
import pytest

from lapspark.llm import minhash
from lapspark.llm.shingle_sets import shingles


def shingled(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def expected(rows, percent=85):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * either:
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(sets[a]), least, i == least))
    return sorted(out, key=repr)


def edited(rnd, base, share):
    """A copy with so many of its words replaced, at random places."""
    w = base.split()
    for k in rnd.sample(range(len(w)), round(share * len(w))):
        w[k] = f"new{rnd.randrange(10 ** 9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def groups():
    """Groups whose copies lie on both sides of the threshold, by edits, by cut ends and along chains."""
    rnd = random.Random(11)
    texts = []
    for size in (30, 80, 300):
        base = " ".join(f"w{rnd.randrange(400)}" for _ in range(size))
        texts += [base, base.upper(), *(edited(rnd, base, rnd.choice([0, 0.01, 0.015, 0.02, 0.03, 0.05])) for _ in range(25))]
        texts += [" ".join(base.split()[:round(size * k)]) for k in (0.8, 0.84, 0.85, 0.86, 0.87, 0.9)]
        step = base
        for _ in range(6):
            step = edited(rnd, step, 0.012)
            texts.append(step)
    return texts + ["one two", "ONE two", "one two three", "a b c d e", "a b c d e f"]


def found(spark, rows, **options):
    schema = "doc_id long, text string, node string, root string, component_id string, source string"
    frame = minhash.component_digest(spark.createDataFrame([(i, t, "n", "r", "c", None) for i, t in rows], schema), **options)
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, frame.collect()), key=repr)


def test_against_all_pairs(spark, groups):
    rows = list(enumerate(groups, 5))
    assert found(spark, rows) == expected(rows)


def test_slices_of_large_buckets(spark, groups, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 8)
    rows = list(enumerate(groups, 5))
    assert found(spark, rows) == expected(rows)


def test_refuted_pairs_are_replaced(spark, groups):
    """With tiny sketches the pairs that the posterior leaves go to the full sets, and many are refuted."""
    rows = list(enumerate(groups, 5))
    assert found(spark, rows, most_bits=64) == expected(rows)


def test_odd_rows(spark, odd_texts):
    rows = [*enumerate(odd_texts), (None, odd_texts[4]), (None, "nobody else says this here"), (None, ""), (3, ""), (3, "one two three four")]
    want = [(i, n, c, i == c) for i, n, c, _ in expected(rows)]
    assert found(spark, rows) == sorted(want, key=repr)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_posterior_bounds():
    least = minhash.least_matches(85)
    assert least == sorted(least) and all(m < 0.85 * n for m, n in zip(least, range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH)))
    rng = np.random.default_rng(1)
    equal = rng.random((200_000, minhash.HASHES)) < 0.85
    assert all((equal[:, :(k + 1) * minhash.BATCH].sum(axis=1) >= m).mean() > 0.9999 for k, m in enumerate(least))


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    for common in (200, 700, 900):
        pool = rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)
        x, y = pool[:1000], pool[-1000:]
        alike = []
        for _ in range(20):
            flip = rng.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1)
            alike.append((minhash.signature(x ^ flip) == minhash.signature(y ^ flip)).mean())
        assert abs(np.mean(alike) - common / (2000 - common)) < 0.04


def test_sketches_never_exclude_more_than_differs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (1, 9, 60, 200, 900)]
    sketch = minhash._Sketches([minhash.parity(s) for s in sets])
    for x, a in enumerate(sets):
        others = np.arange(len(sets))
        assert all(d <= len(np.setxor1d(a, sets[y])) for y, d in zip(others, sketch.differing(x, others)))


def test_kept_rows(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(60))
    docs = make_docs([long, long + " end", "short one", "", None, "short one"])
    got = minhash.remove_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 3, 4]
    assert len(shingles(long, 5)) == 56
