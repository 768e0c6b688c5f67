"""Quality rules: fixed limits first, then gradient-boosted trees over document statistics.

Trees are grown on binned statistics with monotonic constraints: more repetition, symbols, bars, marks or capitals can
never raise a verdict. All trees are flattened into node arrays, and a batch descends all of them level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapspark.llm.common import Scratch
from lapspark.llm.doc_stats import COUNTS, FEATURES, training_rows, with_statistics
from lapspark.llm.quality_gam import binned, cut_points, sigmoid

TRAINING_ROWS = 20_000
#: -1: the verdict may only fall with the statistic.
DIRECTION = {
    "symbols_per_word": -1, "upper_share": -1, "marks_per_word": -1, "bars_per_word": -1, "dup_line_share": -1,
    "repeat_share": -1,
}


@dataclass
class Forest:
    """Node k of tree t: test ``x[feature] <= threshold``, children ``left`` and ``left + 1``; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if not len(self.roots):
            return sigmoid(total)
        for begin in range(0, len(x), 4096):
            part = x[begin:begin + 4096]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                right = part[row, self.feature[node]] > self.threshold[node]
                child = self.left[node]
                node = np.where(child < 0, node, child + right)
            total[begin:begin + 4096] += self.value[node].sum(axis=1)
        return sigmoid(total)


class _Grower:
    def __init__(self, codes: np.ndarray, sizes: list[int], direction: np.ndarray, ridge: float, least: float):
        self.codes, self.sizes, self.direction, self.ridge, self.least = codes, sizes, direction, ridge, least

    def split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        """The best ``(gain, feature, bin)`` whose children respect the directions, their values kept in bounds."""
        best = (1e-6, -1, -1)
        gt, ht = g[rows].sum(), h[rows].sum()
        for f, size in enumerate(self.sizes):
            code = self.codes[rows, f]
            gl = np.cumsum(np.bincount(code, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(code, h[rows], size))[:-1]
            gr, hr = gt - gl, ht - hl
            left = np.clip(-gl / (hl + self.ridge), low, high)
            right = np.clip(-gr / (hr + self.ridge), low, high)
            own = np.clip(-gt / (ht + self.ridge), low, high)
            loss = lambda gs, hs, v: gs * v + 0.5 * (hs + self.ridge) * v * v
            gain = loss(gt, ht, own) - loss(gl, hl, left) - loss(gr, hr, right)
            gain[(hl < self.least) | (hr < self.least) | ((right - left) * self.direction[f] < 0)] = 0
            if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                best = (gain[k], f, k)
        return best

    def tree(self, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list, np.ndarray]:
        """Nodes ``[feature, bin, left, value]`` and the value of every row."""
        nodes: list[list] = [[0, 0, -1, 0.0]]
        out = np.zeros(len(g))
        work = [(0, np.arange(len(g)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + self.ridge), low, high))
            nodes[at][3] = value
            out[rows] = value
            if level == depth:
                continue
            gain, f, k = self.split(rows, g, h, low, high)
            if f < 0:
                continue
            goes_left = self.codes[rows, f] <= k
            sides = rows[goes_left], rows[~goes_left]
            nodes[at][:3] = [f, k, len(nodes)]
            bounds = [(low, high), (low, high)]
            if self.direction[f]:
                # Children of a constrained split stay on their side of its middle.
                a, b = (float(np.clip(-g[r].sum() / (h[r].sum() + self.ridge), low, high)) for r in sides)
                middle = (a + b) / 2
                bounds = [(low, middle), (middle, high)] if self.direction[f] > 0 else [(middle, high), (low, middle)]
            for side, (lo, hi) in zip(sides, bounds):
                work.append((len(nodes), side, level + 1, lo, hi))
                nodes.append([0, 0, -1, 0.0])
        return nodes, out


def fit(x: np.ndarray, y: np.ndarray, direction: dict[str, int] = DIRECTION, trees: int = 80, depth: int = 4,
        rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 2.0) -> Forest:
    """Boosted trees for log-loss. Without rows, or with one class only, the forest has no tree."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    flat: list[list] = []
    roots: list[int] = []
    if len(np.unique(y)) > 1:
        edges = cut_points(x, bins)
        codes = binned(x, edges)
        sign = np.array([direction.get(name, 0) for name in FEATURES[:x.shape[1]]])
        grower = _Grower(codes, [len(e) + 1 for e in edges], sign, ridge, least)
        total = np.full(len(y), intercept)
        for _ in range(trees):
            p = sigmoid(total)
            nodes, out = grower.tree(p - y, p * (1 - p), depth)
            total += rate * out
            shift = len(flat)
            roots.append(shift)
            flat += [[f, edges[f][k] if left >= 0 else 0.0, left + shift if left >= 0 else -1, rate * v] for f, k, left, v in nodes]
    column = lambda k, kind: np.array([n[k] for n in flat], kind)
    return Forest(column(0, np.int64), column(1, np.float64), column(2, np.int64), column(3, np.float64),
                  np.array(roots, np.int64), depth, intercept)


def judge(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, least_words: int = 50,
          repeat_percent: int = 50) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` for every row.

    A row fails the base with fewer than ``least_words`` words or more than ``repeat_percent`` of them in repeated
    windows; any other is kept if the forest scores it 0.5 or more. The forest learns from at most ``limit`` labelled
    rows that are not held out. Null text has no words; repeated rows get equal verdicts; without usable labels every
    score is 0.5; an empty table gives no rows.
    """
    stats = with_statistics(docs, Scratch(docs.sparkSession))
    forest = fit(*training_rows(stats, labels, limit))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES)))
            words, repeats = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
            failed = (words < least_words) | (100 * repeats > repeat_percent * words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(failed),
                 pa.array(~failed & (score >= 0.5)), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    longs = ", ".join(f"{c} long" for c in COUNTS)
    return stats.select("doc_id", *COUNTS, "features").mapInArrow(
        run, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, score double")
