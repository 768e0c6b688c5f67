"""Pairs of texts by the exact Jaccard similarity of their word-shingle sets, 0.8 or more.

Shingles are put into one order for all texts, rare ones first. Two sets of similarity 0.8 share a shingle among the
first fifth of either (prefix filtering), so texts that meet there hold every link. Any order gives the same links; that
of the most frequent ones is estimated from a sample of texts, which only decides how many pairs meet. Shingles with the
same texts count once.

Where texts meet, their parity sketches are joined by binary tries: two sets differ in no fewer shingles than their
sketches in bits, so the error budget that 0.8 allows loses no link, and a pair beyond it is pruned on the way down. Of
what is left only the edges of a spanning forest are proposed, and these are decided on the texts. A shingle with a
refuted edge is looked at again: with the components known by then, at last with all its pairs that are still apart. So a
group of near copies costs about its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, join_rows
from lapspark.operators.joins import join_per_key

#: Texts whose shingles are counted for the order, how often a frequent one stands in them, and how many are ranked.
SAMPLE, OFTEN, RANKED = 16_384, 5, 50_000
#: Rows of one shingle that one task joins; larger groups are cut into slices that meet in pairs.
SLICE = 1024
#: Rows whose tries are walked together.
CELLS = 4096
#: Parity bits of a sketch; fewer exclude less, never a link.
MOST_BITS = 4096


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of all word shingles (ASCII case folded), sorted; none without any word."""
    tokens = text.encode().lower().split()
    k = min(words, len(tokens))
    if not k:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(length + 1) - 1
    start = end - length
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array(
        [digest(joined[a:b], 42) for a, b in zip(start[:len(tokens) - k + 1].tolist(), end[k - 1:].tolist())], np.uint64))


def sketch(values: np.ndarray) -> bytes:
    """For each bit the parity of its values; a power of two of bits, four for each value where that is allowed."""
    bits = min(MOST_BITS, max(64, 1 << (4 * max(1, len(values)) - 1).bit_length()))
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def sets(docs: DataFrame, words: int, frequent: np.ndarray) -> DataFrame:
    """``doc_id, _row, node, size, sketch, prefix`` of ``identified`` texts; ``node`` is a hash of the whole set.

    ``prefix`` is the first fifth of the set in the common order: ``frequent`` shingles come last.
    """
    kind = dict(docs.dtypes)["doc_id"]
    by_hash = np.argsort(frequent)
    ordered = frequent[by_hash]

    def prefix(values: np.ndarray) -> np.ndarray:
        n = len(values)
        rank = np.full(n, -1)
        if n and len(ordered):
            place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
            rank = np.where(ordered[place] == values, by_hash[place], -1)
        return values[np.argsort(rank, kind="stable")[:n - (4 * n + 4) // 5 + 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column("text")]
            node = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), pa.array(node), pa.array([len(v) for v in found], pa.int32()),
                 pa.array([sketch(v) for v in found], pa.binary()), pa.array([prefix(v) for v in found], pa.list_(pa.int64()))],
                ["doc_id", "_row", "node", "size", "sketch", "prefix"])

    return docs.select("doc_id", "_row", "text").mapInArrow(
        run, f"doc_id {kind}, _row long, node long, size int, sketch binary, prefix array<long>")


def frequent_shingles(docs: DataFrame, words: int, scratch: Scratch) -> np.ndarray:
    """The most frequent shingles of a sample of texts, the rarest of them first."""
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < F.lit(max(1, (SAMPLE << 20) // max(1, n))))
    counted = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    often = scratch.table(counted.where(F.col("n") >= OFTEN), "often")
    least, total = OFTEN, 0
    for value, count in sorted(often.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        total += count
        if total > RANKED:
            least = value + 1
            break
    table = often.where(F.col("n") >= least).toArrow()
    shingle = table.column("shingle").to_numpy().view(np.uint64)
    return shingle[np.lexsort((shingle, table.column("n").to_numpy()))]


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of ``words`` or twice as many 64-bit words, all as ``words`` of them."""
    out = np.empty((len(sketches), words), np.uint64)
    for i, raw in enumerate(sketches):
        x = np.frombuffer(raw, np.uint64)
        out[i] = x if len(x) == words else x[:words] ^ x[words:]
    return out


def _passes(width: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Length of sketch and sizes that meet in one pass; the smaller set of a pair is in the lower four fifths of a pass.

    Sketches of the greatest length hold sets of any size, so there one pass covers a doubling of sizes.
    """
    most = MOST_BITS // 64
    for words in np.unique(width[width < most]).tolist():
        yield words, 0, 20 * words
    for octave in np.unique(np.frexp(size[width == most].astype(float))[1]).tolist():
        yield most, 1 << octave - 1, 5 << octave >> 2


def near_pairs(group, node, root, size, sketches, side, barred, every: bool):
    """Pairs of rows of one group that may have similarity 0.8 and different roots: a spanning forest, or ``every`` pair.

    ``side`` is 3 for rows that meet all others of their group, 1 and 2 for rows of two slices that meet only each other;
    ``barred`` has for each row the nodes known not to be linked with it. Sets whose sketches differ in length meet at the
    shorter one, where sizes so far apart as 0.8 allows differ by one doubling at most.
    """
    from lapspark.llm.simhash import _Forest, trie_join

    size = size.astype(np.int64)
    width = np.array([len(s) // 8 for s in sketches])
    forest = _Forest(len(node))
    known = np.lexsort((root, group))
    alike = (group[known][1:] == group[known][:-1]) & (root[known][1:] == root[known][:-1])
    for _ in forest.join(known[:-1][alike], known[1:][alike]):
        pass

    def taken(x: np.ndarray, y: np.ndarray, fp: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # ``at`` are the places in this pass; x and y are rows.
        differ = np.bitwise_count(fp[at[x]] ^ fp[at[y]]).sum(axis=1, dtype=np.int64)
        ok = (group[x] == group[y]) & (root[x] != root[y]) & ((side[x] == 3) | (side[y] == 3) | (side[x] != side[y]))
        ok &= (9 * differ <= size[x] + size[y]) & (5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        if len(x):
            free = np.array([b not in barred[i] and a not in barred[j] for i, j, a, b in zip(x, y, node[x], node[y])], bool)
            x, y = x[free], y[free]
        if every:
            yield x, y
        else:
            yield from forest.join(x, y)

    for words, low, high in _passes(width, size):
        rows = np.flatnonzero(((width == words) | (width == 2 * words)) & (size >= low) & (size <= high))
        if len(rows) < 2:
            continue
        fp = _folded([sketches[i] for i in rows], words)
        order = np.lexsort((*fp.T[::-1], group[rows]))
        rows, fp = rows[order], fp[order]
        at = np.full(len(node), -1)
        at[rows] = np.arange(len(rows))
        # Rows of one sketch are one leaf of the trie: its first row stands for all.
        new = np.r_[True, (group[rows][1:] != group[rows][:-1]) | (fp[1:] != fp[:-1]).any(axis=1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(rows)]
        for s, e in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
            for k in range(s, e - 1):
                yield from taken(np.full(e - k - 1, rows[k]), rows[k + 1:e], fp, at)
        errors = int(2 * size[rows].max() // 9)  # the sum of two sizes over nine, at most
        single = last - first == 1
        # Leaves that hang together already need not meet again; those of several rows stay apart.
        leaf, leaves = np.repeat(np.arange(len(first)), last - first), _Forest(len(first))
        together = np.where(single, forest.roots(np.arange(len(node)))[rows[first]], -1 - np.arange(len(first)))
        by_root = np.argsort(together, kind="stable")
        alike = together[by_root][1:] == together[by_root][:-1]
        for _ in leaves.join(by_root[:-1][alike], by_root[1:][alike]):
            pass

        def met(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            one = single[x] & single[y]
            for a, b in taken(rows[first[x[one]]], rows[first[y[one]]], fp, at):
                yield a, b
                if not every:
                    for _ in leaves.join(leaf[at[a]], leaf[at[b]]):
                        pass
            for i, j in zip(x[~one].tolist(), y[~one].tolist()):
                a, b = rows[first[i]:last[i]], rows[first[j]:last[j]]
                yield from taken(np.repeat(a, len(b)), np.tile(b, len(a)), fp, at)

        # Near leaves of the sorted order come first; within groups of near copies they connect almost everything.
        for step in () if every else (1, 2, 3, 5, 8, 13):
            yield from met(np.arange(max(0, len(first) - step)), np.arange(min(step, len(first)), len(first)))
        for x, y in trie_join(group[rows][first], fp[first], np.full(len(first), 3), errors, leaves):
            yield from met(x, y)


def _proposals(rows: DataFrame, cross: bool, every: bool) -> DataFrame:
    """``a, b, key``: what the shingles in ``rows`` (``key, node, members, low, root, barred, size, sketch``) propose.

    Without ``cross`` only rows of one slice meet, and the smallest of the shingle meets all.
    """
    from lapspark.llm.minhash import _whole_groups

    slices = F.when(F.col("members") > SLICE, F.ceil(F.col("members") / (SLICE // 2))).otherwise(1).cast("int")
    rows = rows.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    every_slice = F.sequence(F.lit(0), F.col("slices") - 1)
    if cross:
        partners = F.transform(every_slice, lambda j: F.struct(F.least("slice", j).alias("i"), F.greatest("slice", j).alias("j")))
    else:
        own = F.when(F.col("node") == F.col("low"), every_slice).otherwise(F.array("slice"))
        partners = F.transform(own, lambda j: F.struct(j.alias("i"), j.alias("j")))
    meeting = rows.withColumn("pair", F.explode(partners)).select(
        "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "root", "size", "sketch", "barred",
        F.when(F.col("pair.i") == F.col("pair.j"), 3).when(F.col("slice") == F.col("pair.i"), 1).otherwise(2).alias("side"))
    group, most = ["key", "i", "j"], CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, group, most):
            c = {k: table.column(k).to_numpy() for k in ("key", "node", "root", "size", "side")}
            of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            # The smallest nodes come first, so shingles of similar texts propose the same edges.
            order = np.lexsort((c["node"], of))
            sketches, barred = table.column("sketch").to_pylist(), [set(b) for b in table.column("barred").to_pylist()]
            found = list(near_pairs(
                of[order], c["node"][order], c["root"][order], c["size"][order], [sketches[k] for k in order], c["side"][order],
                [barred[k] for k in order], every))
            x, y = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            a, b = c["node"][order][x], c["node"][order][y]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c["key"][order][x])], ["a", "b", "key"])

    return meeting.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, key long")


def meetings(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, node, members, low``: the ``nodes`` (``node, prefix``) of each shingle of several; shingles of the same nodes once.

    Most shingles stand in one set only. They go first, by counts alone, so hashes of members are made and dealt for the rest.
    """
    prefixes = nodes.select(F.explode("prefix").alias("key"), "node")
    several = scratch.table(prefixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    # Read from its table, ``several`` is dealt for the join, which adaptive execution can split at a hot shingle.
    common = scratch.table(prefixes.join(several, "key", "left_semi"), "common")
    scratch.drop("several")
    shared = common.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("low"),
        F.expr("bit_xor(xxhash64(node))").alias("_h1"), F.expr("bit_xor(xxhash64(node, 1))").alias("_h2"))
    kept = shared.groupBy("members", "low", "_h1", "_h2").agg(F.min("key").alias("key"))
    met = scratch.table(join_per_key(common, kept.select("key", "members", "low"), ["key"]), "meetings")
    scratch.drop("common")
    return met


def links(docs: DataFrame, nodes: DataFrame, met: DataFrame, words: int, components: Callable, scratch: Scratch) -> DataFrame:
    """``a, b``: edges that connect the ``nodes`` (``node, size, sketch, doc_id, _row``) of similarity 0.8 or more.

    ``docs`` is ``identified``, ``met`` has the ``meetings`` of the nodes; ``components`` gives ``node, root`` of edges.
    """
    from lapspark.llm.minhash import _confirmed, _open_buckets

    wanted = join_per_key(nodes, met.select("node").distinct(), ["node"], "left_semi").select("doc_id", "_row", "node")
    found = join_rows(docs.select("doc_id", "_row", "text"), wanted, "inner")
    texts = scratch.table(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    known = nodes.select("node", "size", "sketch")
    rows = met.withColumn("root", F.col("node")).withColumn("barred", F.array().cast("array<long>"))
    decided = None
    for k, (cross, every) in enumerate(((False, False), (True, False), (True, True))):
        offers = scratch.table(_proposals(join_per_key(rows, known, ["node"]), cross, every), f"offers{k}")
        verdict = scratch.table(_confirmed(offers.select("a", "b").distinct(), texts, words, 80), f"verdict{k}")
        decided = verdict if decided is None else decided.unionByName(verdict)
        if every:
            break
        again = join_per_key(offers, verdict.where("NOT linked").select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
        if not cross:
            again = again.unionByName(met.where(F.col("members") > SLICE).select("key")).distinct()
        if again.isEmpty():
            break
        rows = _open_buckets(met, again, decided, scratch)
    # Only the verdicts are read from here on.
    scratch.drop("texts", "meetings", *(name for name in scratch.paths if name.startswith("offers")))
    return decided.where("linked").select("a", "b")
