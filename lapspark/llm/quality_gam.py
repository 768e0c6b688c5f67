"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees are boosted on one feature after the other, round after round, and add up
to one lookup table per feature; then the same is done for the pairs of features that explain most of what is left. A
score is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, carried, join_rows, restored
from lapspark.llm.doc_stats import FEATURES, held_out, training_rows, with_statistics

#: Rows at most that the model is fitted on (collected to the driver: 15 numbers each).
TRAINING_ROWS = 20_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges of up to ``bins`` bins for each column, at its quantiles."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at)) if len(c) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)


@dataclass
class Gam:
    edges: list[np.ndarray]
    intercept: float
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, wide = binned(x, self.edges), binned(x, self.coarse)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.single):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[wide[:, i], wide[:, j]]
        return sigmoid(total)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """Leaf values of a tree over ordered bins, split greedily up to ``leaves`` leaves."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                continue
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            gain = _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(gs[-1], hs[-1], ridge)
            gain[(hl < least) | (hr < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    value = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        value[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return value


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four quadrants: its gain and the value of each cell."""
    gs, hs = g.cumsum(0).cumsum(1)[:-1, :-1], h.cumsum(0).cumsum(1)[:-1, :-1]
    value = np.zeros(g.shape)
    if not gs.size:
        return 0.0, value
    g0, h0, g1, h1 = g.sum(1).cumsum()[:-1, None], h.sum(1).cumsum()[:-1, None], g.sum(0).cumsum()[None, :-1], h.sum(0).cumsum()[None, :-1]
    gt, ht = g.sum(), h.sum()
    parts = [(gs, hs), (g0 - gs, h0 - hs), (g1 - gs, h1 - hs), (gt - g0 - g1 + gs, ht - h0 - h1 + hs)]
    gain = sum(_gain(a, b, ridge) for a, b in parts) - _gain(gt, ht, ridge)
    gain = np.where(np.minimum.reduce([b for _, b in parts]) >= least, gain, 0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, value
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            value[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 80, rate: float = 0.15, n_pairs: int = 6,
        pair_bins: int = 8, pair_rounds: int = 30, ridge: float = 2.0, least: float = 1.0) -> Gam:
    """Fitted tables. Without rows, or with one class only, the model is a constant near that class."""
    edges, coarse = cut_points(x, bins), cut_points(x, pair_bins)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    codes, wide = binned(x, edges), binned(x, coarse)
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.single):
            p = sigmoid(total)
            g = np.bincount(codes[:, j], p - y, len(table))
            h = np.bincount(codes[:, j], p * (1 - p), len(table))
            step = rate * _shallow(g, h, ridge, least)
            table += step
            total += step[codes[:, j]]

    def gradients(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        p, cell = sigmoid(total), wide[:, i] * shape[1] + wide[:, j]
        size = shape[0] * shape[1]
        return np.bincount(cell, p - y, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape), cell

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_quadrants(*gradients(*ij)[:2], ridge, least)[0])
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h, cell = gradients(i, j)
            step = rate * _quadrants(g, h, ridge, least)[1]
            table += step
            total += step.ravel()[cell]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, _row, held_out, score, predicted`` for every row; nothing but the text enters a score.

    The model learns from at most ``limit`` labelled rows (``doc_id, quality``) that are not held out. Null text is
    empty and scored like any other; a null id is not held out and has no label; repeated rows get equal scores; without
    usable labels every score is 0.5; an empty table gives no rows.
    """
    stats = with_statistics(docs, Scratch(docs.sparkSession))
    model = fit(*training_rows(stats, labels, limit))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "_row", "held_out", "score", "predicted"],
            )

    return stats.select("doc_id", "_row", held_out().alias("held_out"), "features").mapInArrow(
        run, f"doc_id {kind}, _row long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the rows the classifier rejects, columns unchanged."""
    rejected = score_quality(docs, labels, limit).where("predicted = 0").select("doc_id", "_row").distinct()
    return restored(join_rows(carried(docs), rejected, "left_anti"), docs)
