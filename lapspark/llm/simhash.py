"""SimHash near-duplicates by a self-join over binary tries.

Fingerprints meet in groups that agree in chosen bits. In a group a binary trie is traversed in pairs of nodes, all
groups of a task level by level: the differing bits add up along the way, and a pair of nodes is dropped when they
exceed the budget. Only distinct fingerprints take part, however many copies share one. A group passes on the edges of
its spanning forest instead of all its pairs.

The 64 bits are cut into parts and every choice of parts that must hold an agreeing one is taken (``exact_masks``), so
no link is lost. Near copies by the similarity of word shingles are decided on the shingle sets (``shingle_sets``):
fingerprints do not tell 0.8 from somewhat less.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapspark.llm import shingle_sets
from lapspark.llm.common import Scratch, carried, identified, join_rows, restored
from lapspark.operators.joins import join_per_key

BITS, BLOCKS = 64, 6
#: Node pairs expanded at once.
FRONTIER = 1 << 15
#: Rows of one group that one task joins; larger groups are cut into slices that meet in pairs.
SLICE = 16_384


def fingerprint(text: str, words: int = 4, width: int = 1, seed: int = 42) -> np.ndarray:
    """``width`` times 64 majority bits over the hashes of all word shingles (ASCII case folded); zero without any word.

    The first 64 bits come from the XXH64 values themselves, further ones from remixing these.
    """
    tokens = text.encode().lower().split()
    out = np.zeros(width, np.uint64)
    if not tokens:
        return out
    joined = memoryview(b" ".join(tokens))
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(start[:len(tokens) - k + 1].tolist(), end[k - 1:].tolist())], np.uint64)
    ones = np.zeros((width, BITS), np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin:begin + (1 << 16)]
        for w in range(width):
            bits = part if not w else _remixed(part, w)
            ones[w] += np.unpackbits(bits[:, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _remixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _columns(width: int) -> list[str]:
    return [f"fp{k}" for k in range(width)]


def fingerprints(docs: DataFrame, words: int = 4, width: int = 1) -> DataFrame:
    """``doc_id, _row, fp0, fp1, ...`` (signed 64 bits each) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words, width) for t in batch.column("text")], np.uint64)
            fp = fp.reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)],
                ["doc_id", "_row", *_columns(width)])

    return identified(docs).mapInArrow(run, f"doc_id {kind}, _row long, " + ", ".join(f"{c} long" for c in _columns(width)))


def exact_masks(errors: int) -> list[list[int]]:
    """Bits in which two fingerprints of 64 bits must agree for some mask if at most ``errors`` bits differ."""
    edge = [round(BITS * k / BLOCKS) for k in range(BLOCKS + 1)]
    block = [((1 << edge[k + 1] - edge[k]) - 1) << edge[k] for k in range(BLOCKS)]
    return [[sum(c)] for c in combinations(block, BLOCKS - errors)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class _Forest:
    """Union-find over row numbers, for many pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.joined = 0

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = x = self.parent[up]

    def join(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Join all pairs; gives those that were needed for it."""
        while len(x):
            a, b = self.roots(x), self.roots(y)
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            # Each larger root gets one smaller parent, so no cycle can arise.
            top, pick = np.unique(np.maximum(a, b), return_index=True)
            self.parent[top] = np.minimum(a, b)[pick]
            self.joined += len(top)
            yield x[pick], y[pick]


def _linked(x: np.ndarray, y: np.ndarray, fp: np.ndarray, side: np.ndarray, errors: int) -> np.ndarray:
    """Which rows may meet and differ in at most ``errors`` bits."""
    meet = (x != y) & ((side[x] == 3) | (side[x] != side[y]))
    return meet & (np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= errors)


def trie_join(group: np.ndarray, fp: np.ndarray, side: np.ndarray, errors: int, forest: _Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group with at most ``errors`` differing bits, in batches.

    Rows are sorted by group and fingerprint, each fingerprint once. A node of depth d is a run of rows that agree in
    the group and the first d bits. ``side`` is 3 for rows that meet all others of their group, 1 and 2 for rows of two
    slices, which meet only each other (pairs within a slice are found elsewhere). Two nodes whose rows all hang
    together in ``forest`` already are left out: their pairs would connect nothing, so a large group of near copies does
    not cost the square of its size.
    """
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    several = ends - starts > 1
    depths = BITS * fp.shape[1]
    stack = [(0, starts[several], ends[several], starts[several], ends[several],
              np.zeros(int(several.sum()), np.int16))]
    # For each depth, how many rows before a place have a one there: sorted runs split after their zeros.
    ones: dict[int, np.ndarray] = {}
    root, breaks, known = np.arange(n), np.arange(n), -1
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        if not len(a0):
            continue
        if len(a0) > 256:
            if forest.joined != known:
                known, root = forest.joined, forest.roots(np.arange(n))
                breaks = np.r_[0, np.cumsum(root[1:] != root[:-1])]
            done = (breaks[a1 - 1] == breaks[a0]) & (breaks[b1 - 1] == breaks[b0]) & (root[a0] == root[b0])
            if done.any():
                rest = ~done
                a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for cut in (slice(half), slice(half, None)):
                stack.append((depth, a0[cut], a1[cut], b0[cut], b1[cut], spent[cut]))
            continue
        # Two single rows need no further descent.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            ok = _linked(x, y, fp, side, errors)
            if ok.any():
                yield x[ok], y[ok]
            rest = ~single
            a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
        if depth == depths or not len(a0):
            continue
        if depth not in ones:
            bit = fp[:, depth // BITS] >> np.uint64(BITS - 1 - depth % BITS) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit, dtype=np.int64)]
        count = ones[depth]
        am = a1 - (count[a1] - count[a0])
        bm = b1 - (count[b1] - count[b0])
        same = a0 == b0
        nodes = []
        for lo_a, hi_a, lo_b, hi_b, cost, keep in (
            (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same),
        ):
            ok = (hi_a > lo_a) & (hi_b > lo_b) & (spent + cost <= errors)
            # A single row paired with itself has nothing to find.
            ok &= ~((lo_a == lo_b) & (hi_a - lo_a == 1))
            if keep is not None:
                ok &= keep
            nodes.append((lo_a[ok], hi_a[ok], lo_b[ok], hi_b[ok], (spent[ok] + cost).astype(np.int16)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*nodes))))


def _edges(node: np.ndarray, group: np.ndarray, fp: np.ndarray, side: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that span the linked rows of every group."""
    forest, left, right = _Forest(len(fp)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(x: np.ndarray, y: np.ndarray) -> None:
        for a, b in forest.join(x, y):
            left.append(a)
            right.append(b)

    # Near rows of the sorted order come first; within groups of near copies they connect almost everything.
    for step in (1, 2, 3, 5, 8, 13):
        x = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.zeros(0, np.int64)
        ok = _linked(x, x + step, fp, side, errors)
        take(x[ok], x[ok] + step)
    for x, y in trie_join(group, fp, side, errors, forest):
        take(x, y)
    return node[np.concatenate(left)], node[np.concatenate(right)]


def links(distinct: DataFrame, masks: list[list[int]], errors: int, batch_rows: int = 100_000) -> DataFrame:
    """``a, b``: edges that connect the nodes of ``distinct`` (``node, fp0, ...``) with at most ``errors`` differing bits."""
    fps = _columns(len(masks[0]))
    parts = [[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(fps, mask)] for mask in masks]
    keys = F.array(*[
        F.struct(F.lit(k).alias("choice"), (F.xxhash64(*part) if len(part) > 1 else part[0]).alias("part"))
        for k, part in enumerate(parts)
    ])
    rows = distinct.select("node", *fps, F.explode(keys).alias("key")).select("node", *fps, "key.*")
    # Larger groups are cut into slices; slice pairs (i, j) become groups of their own.
    large = rows.groupBy("choice", "part").agg(F.count("*").alias("n")).where(F.col("n") > SLICE)
    rows = join_per_key(rows, large, ["choice", "part"], "left")
    slices = F.coalesce(F.ceil(F.col("n") / (SLICE // 2)), F.lit(1)).cast("int")
    rows = rows.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    partners = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda j: F.struct(F.least("slice", j).alias("i"), F.greatest("slice", j).alias("j")),
    )
    meeting = rows.select("node", *fps, "choice", "part", "slice", F.explode(partners).alias("pair")).select(
        "node", *fps, "choice", "part", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"),
        F.when(F.col("pair.i") == F.col("pair.j"), 3).when(F.col("slice") == F.col("pair.i"), 1).otherwise(2).alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table.column(c).to_numpy() for c in table.column_names}
            fp = [columns[c].view(np.uint64) for c in fps]
            order = np.lexsort((*fp[::-1], columns["j"], columns["i"], columns["part"], columns["choice"]))
            columns = {c: v[order] for c, v in columns.items()}
            fp = np.stack([c[order] for c in fp], axis=1)
            new = np.zeros(len(fp), bool)
            for c in ("choice", "part", "i", "j"):
                new[1:] |= columns[c][1:] != columns[c][:-1]
            a, b = _edges(columns["node"], np.cumsum(new), fp, columns["side"], errors)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def whole_groups(table: pa.Table) -> tuple[pa.Table, pa.Table]:
            last = np.zeros(len(table), bool)
            for c in ("choice", "part", "i", "j"):
                v = table.column(c).to_numpy()
                last |= v != v[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            return table.slice(0, cut), table.slice(cut)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= batch_rows:
                done, rest = whole_groups(pa.Table.from_batches(held))
                if len(done):
                    yield joined(done)
                held = rest.to_batches()
                n = len(rest)
        if n:
            yield joined(pa.Table.from_batches(held))

    at = ["choice", "part", "i", "j"]
    return meeting.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node that can be reached.

    Alternating large-star and small-star steps: each rewires edges towards the smallest neighbour, so a component
    becomes a star in a number of rounds that grows with the logarithm of its size. Rounds are written as tables.
    """
    def smallest(pairs: DataFrame, up: bool) -> DataFrame:
        # (u, v) with v a neighbour of u; the neighbours move to the smallest of u and its neighbours.
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = join_per_key(pairs, least, ["u"])
        if up:
            moved = moved.where("v > u")
        out = moved.select(F.col("v").alias("x"), F.col("m").alias("y"))
        if not up:
            out = out.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    edges = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before, k = None, 0
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = smallest(both, up=True)
        small = smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), up=False)
        k += 1
        after = scratch.table(small, f"edges{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges{k - 1}")
        edges = after
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, words: int, width: int, masks: list[list[int]], errors: int) -> DataFrame:
    """``doc_id, _row, fp0, ..., component_id`` for every row: the smallest ``doc_id`` it is linked with, itself included.

    Empty and null texts have fingerprint zero and link like any other; rows without ``doc_id`` take part and get the
    smallest id of the others, if any; repeated rows get equal results; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    fps = _columns(width)
    node = F.xxhash64(*fps) if width > 1 else F.col("fp0")
    rows = scratch.table(fingerprints(docs, words, width).withColumn("node", node), "fingerprints")
    least = scratch.table(
        rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in fps)), "distinct")
    found = components(links(least, masks, errors), scratch).withColumnRenamed("node", "found")
    rooted = least.select("node", "least").join(found, F.col("node") == F.col("found"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_per_key(rooted, smallest, ["root"]).select("node", "component_id")
    return join_per_key(rows, named, ["node"]).select("doc_id", "_row", *fps, "component_id")


def fingerprint_digest(docs: DataFrame, errors: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``, the fingerprint as 16 hex digits (see ``near_duplicates``)."""
    return near_duplicates(docs, words, 1, exact_masks(errors), errors).select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with only the row of the smallest ``doc_id`` of each group of near copies.

    Near copies share four fifths or more of their distinct ``words``-word shingles (exact Jaccard similarity, see
    ``shingle_sets``) or are connected by such links. A text of fewer words is one shingle; texts without a word are
    copies of each other. Rows without an id come after all others; of rows with one id the smallest hash of the text
    stays, of repeated rows one.
    """
    scratch, known = Scratch(docs.sparkSession), identified(docs)
    answer = Scratch(docs.sparkSession)
    frequent = shingle_sets.frequent_shingles(known, words, scratch)
    rows = scratch.table(shingle_sets.sets(known, words, frequent), "sets")
    id_first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    whole = scratch.table(
        rows.groupBy("node").agg(F.min(id_first).alias("least"), *(F.first(c).alias(c) for c in ("size", "sketch", "prefix")))
        .select("node", "size", "sketch", "prefix", "least.doc_id", "least._row"), "whole")
    scratch.drop("often", "sets")
    met = shingle_sets.meetings(whole, scratch)
    nodes = scratch.table(whole.drop("prefix"), "distinct")
    scratch.drop("whole")
    edges = shingle_sets.links(known, nodes, met, words, components, scratch)
    found = components(edges, scratch).withColumnRenamed("node", "found")
    rooted = nodes.join(found, F.col("node") == F.col("found"), "left").select(
        "doc_id", "_row", F.coalesce("root", "node").alias("root"))
    chosen = answer.table(
        rooted.groupBy("root").agg(F.min(id_first).alias("least")).select("least.doc_id", "least._row"), "chosen")
    scratch.drop()
    first = Window.partitionBy("_row", "doc_id").orderBy(F.lit(1))
    kept = join_rows(carried(docs), chosen, "left_semi").withColumn("_nth", F.row_number().over(first))
    return restored(kept.where("_nth = 1"), docs)
