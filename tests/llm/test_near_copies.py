"""Near copies of the pipeline against the exact similarity of all pairs of shingle sets."""

import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lapspark.llm import shingle_sets, simhash
from lapspark.llm.common import Scratch


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_brute_force(texts):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or (a and b and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return sorted(set(label))


def near_texts(rnd):
    word = lambda: f"w{rnd.randint(0, 10 ** 6)}"
    text = lambda n: [word() for _ in range(n)]
    out = []
    for n in (6, 8, 9, 10, 13, 14, 20, 49, 54, 94, 200, 500):
        for _ in range(6):
            base = text(n)
            out.append(base)
            # Words changed at one end take as many shingles each, so similarities lie close to both sides of 0.8.
            shingle = n - 4
            for changed in {max(1, shingle // 9 + d) for d in (-1, 0, 1)}:
                out.append(base[:-changed] + text(changed))
            out.append(base + [word()])
            out.append(base[:-1])
    line = text(20)
    for _ in range(12):
        # One line many times between own words: most shingles are those of the line.
        out.append(line * 8 + text(140))
        out.append([w for k in range(10) for w in line + text(3)])
    hub = text(150)
    out += [hub[:k] + text(1) + hub[k + 1:] for k in range(0, 150, 2)]
    return [" ".join(t) for t in out] + ["", None, " \n", "Same Words here", "same words HERE"]


def kept(make_docs, texts):
    return sorted(r.doc_id for r in simhash.keep_one_of_each(make_docs(texts)).select("doc_id").collect())


def test_near_copies_are_those_of_brute_force(make_docs):
    texts = near_texts(random.Random(12))
    assert kept(make_docs, texts) == kept_by_brute_force(texts)


def test_slices_and_order_do_not_show(make_docs, monkeypatch):
    texts = near_texts(random.Random(13))
    monkeypatch.setattr(shingle_sets, "SLICE", 10)
    monkeypatch.setattr(shingle_sets, "CELLS", 100)
    monkeypatch.setattr(shingle_sets, "RANKED", 30)
    assert kept(make_docs, texts) == kept_by_brute_force(texts)


@pytest.mark.parametrize("shared, linked", [(8, True), (7, False)])
def test_border_of_similarity(make_docs, shared, linked):
    # Nine shingles each: eight shared of ten give exactly 0.8, seven of eleven less.
    a = [f"a{k}" for k in range(13)]
    b = [*a[:shared + 4], *(f"b{k}" for k in range(9 - shared))]
    assert kept(make_docs, [" ".join(a), " ".join(b)]) == ([0] if linked else [0, 1])


def test_one_row_stays_without_ids_and_with_equal_ones(spark):
    rnd = random.Random(14)
    a, b, c = (" ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(100)) for _ in range(3))
    rows = [(5, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (1, c), (1, c + " more"), (2, c)]
    out = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 5]
    assert {r.text[:40] for r in out} == {x[:40] for x in (a, b, c)}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size())}


def test_scratch_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    scratch = Scratch(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table = scratch.table(counts, "counts")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting) == was
    assert table.agg(F.sum("n")).first()[0] == 1000
    scratch.drop()


def test_meetings_are_the_shared_prefixes(spark):
    prefixes = {1: [10, 11, 12], 2: [11, 12, 13], 3: [13, 14], 4: [], 5: [14, 10, 15]}
    nodes = spark.createDataFrame(list(prefixes.items()), "node long, prefix array<long>")
    scratch = Scratch(spark)
    got = {}
    for r in shingle_sets.meetings(nodes, scratch).collect():
        got.setdefault(r.key, []).append((r.node, r.members, r.low))
    # 11 and 12 have the same nodes and count once; 15 stands in one set only.
    assert {k: sorted(v) for k, v in got.items()} == {
        10: [(1, 2, 1), (5, 2, 1)], 11: [(1, 2, 1), (2, 2, 1)], 13: [(2, 2, 2), (3, 2, 2)], 14: [(3, 2, 3), (5, 2, 3)]}
    assert list(scratch.paths) == ["meetings"]
    scratch.drop()
