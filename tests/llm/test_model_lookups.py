"""Vectorised scores of both quality models against plain lookups and recursive walks, row by row."""

import math

import numpy as np
import pytest

from lapspark.llm import doc_stats, quality_gam, quality_gbt
from lapspark.llm.common import Scratch, read

SF = "/root/testdata/sf0.001"


def logistic(v):
    return 1 / (1 + math.exp(-v))


def bin_of(value, edges):
    """How many edges lie below the value (a value on an edge stays in the lower bin)."""
    return sum(value > e for e in edges)


def gam_score(model, row):
    total = model.intercept
    for value, edges, table in zip(row, model.edges, model.single):
        total += table[bin_of(value, edges)]
    for i, j, table in model.pairs:
        total += table[bin_of(row[i], model.coarse[i])][bin_of(row[j], model.coarse[j])]
    return logistic(total)


def tree_value(forest, node, row):
    if forest.left[node] < 0:
        return forest.value[node]
    goes_right = row[forest.feature[node]] > forest.threshold[node]
    return tree_value(forest, forest.left[node] + int(goes_right), row)


def forest_score(forest, row):
    return logistic(forest.intercept + sum(tree_value(forest, root, row) for root in forest.roots))


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = read(spark, SF, "documents"), doc_stats.quality_labels(spark, SF)
    stats = doc_stats.with_statistics(docs, Scratch(spark))
    rows = {r.doc_id: list(r.features) for r in stats.select("doc_id", "features").collect()}
    return docs, labels, rows, doc_stats.training_rows(stats, labels, 20_000)


def test_classifier_scores(trained):
    docs, labels, rows, sample = trained
    model = quality_gam.fit(*sample)
    got = {r.doc_id: (r.score, r.predicted) for r in quality_gam.score_quality(docs, labels).collect()}
    assert got.keys() == rows.keys() and len(model.pairs) == 6
    for i, row in rows.items():
        want = gam_score(model, row)
        assert got[i][0] == pytest.approx(want, abs=1e-12) and got[i][1] == int(got[i][0] >= 0.5)


def test_rule_verdicts(trained):
    docs, labels, rows, sample = trained
    forest = quality_gbt.fit(*sample)
    got = {r.doc_id: r for r in quality_gbt.judge(docs, labels).collect()}
    assert got.keys() == rows.keys() and len(forest.roots) == 80
    for i, row in rows.items():
        want = forest_score(forest, row)
        assert got[i].score == pytest.approx(want, abs=1e-12)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= 0.5)


def test_values_on_edges_and_beyond(trained):
    _, _, _, (x, y) = trained
    model, forest = quality_gam.fit(x, y), quality_gbt.fit(x, y)
    edge = np.array([e[len(e) // 2] if len(e) else 0.0 for e in model.edges])
    odd = np.array([edge, edge + 1e-9, np.full(len(edge), -1e300), np.full(len(edge), 1e300), np.zeros(len(edge))])
    assert model.score(odd) == pytest.approx([gam_score(model, r) for r in odd], abs=1e-12)
    assert forest.score(odd) == pytest.approx([forest_score(forest, r) for r in odd], abs=1e-12)


@pytest.mark.parametrize("operator", [quality_gam.score_quality, quality_gbt.judge])
def test_repeated_rows_null_ids_and_long_texts(spark, make_docs, operator):
    labels = doc_stats.quality_labels(spark, SF)
    docs = make_docs(["plain words of a text " * 20, "word " * 200_000, None, ""])
    nameless = docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    got = operator(docs.unionByName(docs).unionByName(nameless), labels).collect()
    scores = {k: [r.score for r in got if r.doc_id == k] for k in range(4)}
    # Repeated labelled rows are learned from twice, so the equalities hold within one run.
    assert len(got) == 12 and all(len(s) == 2 and s[0] == s[1] for s in scores.values())
    assert scores[2] == scores[3]
    assert sorted(r.score for r in got if r.doc_id is None) == sorted(s[0] for s in scores.values())
