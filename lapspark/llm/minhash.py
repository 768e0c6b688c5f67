"""Near duplicates by MinHash with sequential Bayesian verification.

Each distinct shingle set gets a signature of independent minima. Bands of the signature bring candidates together; in a
bucket, candidates are compared one batch of minima after the other, and a pair is given up as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold falls below the chosen miss probability. What is left
must pass the parity sketches, which never exclude a link, and is confirmed on the full sets.

A bucket proposes the edges of a spanning forest of its surviving pairs, not all of them, so a group of near copies costs
about its size. Where a proposed edge is refuted on the full sets, its bucket is looked at again, first with the forest of
what hangs together by then, then with every surviving pair that is left. So no surviving pair between two components goes
undecided. Buckets of the same members count once; large ones are cut into slices, each with the bucket's smallest node
first, then all slices in pairs where the bucket still holds several components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapspark.llm.common import Scratch, carried, identified, join_rows, restored
from lapspark.llm.shingle_sets import shingles
from lapspark.llm.simhash import components
from lapspark.operators.joins import join_per_key

#: At similarity 0.85 a pair shares no band with probability (1 - 0.85 ** 5) ** 24, less than one in a million.
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Minima compared at once, and the probability of giving up a pair of the threshold's similarity.
BATCH, MISS = 24, 1e-6
#: Parity bits of a sketch: four for each shingle at least, but no more than these. Fewer bits exclude less, never a link.
MOST_BITS = 1 << 16
#: Members of a bucket that one task compares; larger buckets are cut into slices.
SLICE = 1024


def _constants(seed: int) -> np.ndarray:
    k = np.arange(seed * HASHES, (seed + 1) * HASHES, dtype=np.uint64) + np.uint64(1)
    return (k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(13)).astype(np.uint32)


_FLIP, _FACTOR = _constants(0), _constants(1) | np.uint32(1)


def signature(values: np.ndarray) -> np.ndarray:
    """The upper 16 bits of the minimum of each hash function over a set of 64-bit shingle hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for begin in range(0, len(x), 512):
        np.minimum(least, ((x[begin:begin + 512, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return (least >> np.uint32(16)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(signatures), BANDS)).copy()
    values = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        key = (key ^ values[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal minima with which a pair goes on.

    With a uniform prior, m equal minima of n leave the posterior Beta(m + 1, n - m + 1); the probability that the
    similarity is t or more is that of at most m successes in n + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss * BATCH / HASHES:
            m += 1
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def parity(values: np.ndarray, most_bits: int = MOST_BITS) -> bytes:
    """For each bit (a power of two of them) whether an odd number of values falls on it."""
    bits = min(most_bits, max(64, 1 << (4 * max(1, len(values)) - 1).bit_length()))
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class _Sketches:
    """The sketches of some sets, compared one against many; two of different length meet at the shorter one."""

    def __init__(self, sketches: list[bytes]):
        length = np.array([len(s) // 8 for s in sketches])
        self.length, self.at, self.rows = length, np.zeros(len(sketches), np.int64), {}
        for size in np.unique(length).tolist():
            members = np.flatnonzero(length == size)
            self.at[members] = np.arange(len(members))
            self.rows[size] = np.frombuffer(b"".join(sketches[i] for i in members), np.uint64).reshape(-1, size)

    def differing(self, x: int, others: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(others), np.int64), int(self.length[x])
        for size in np.unique(self.length[others]).tolist():
            chosen = self.length[others] == size
            a, b = self.rows[own][self.at[x]][None], self.rows[size][self.at[others[chosen]]]
            while a.shape[1] > b.shape[1]:
                a = a[:, :a.shape[1] // 2] ^ a[:, a.shape[1] // 2:]
            while b.shape[1] > a.shape[1]:
                b = b[:, :b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]
            out[chosen] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


def surviving_pairs(node, root, size, signatures, sketches, side, barred, percent: int, least: list[int], every: bool):
    """Pairs (row numbers) that may be links: a spanning forest of those between different roots, or ``every`` such pair.

    ``side`` is 3 for rows that meet all others, 1 and 2 for rows of two slices that meet only each other. ``barred`` has
    for each row the nodes it is known not to be linked with.
    """
    n = len(node)
    sketch = _Sketches(sketches)
    part = np.unique(root, return_inverse=True)[1]
    size = size.astype(np.int64)
    for x in range(n - 1):
        y = np.arange(x + 1, n)
        meet = (part[y] != part[x]) & ((side[y] == 3) | (side[x] == 3) | (side[y] != side[x]))
        meet &= 100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])
        y = y[meet]
        equal = np.zeros(len(y), np.int64)
        for k, fewest in enumerate(least):
            if not len(y):
                break
            batch = slice(k * BATCH, (k + 1) * BATCH)
            equal += (signatures[y, batch] == signatures[x, batch]).sum(axis=1)
            go = equal >= fewest
            y, equal = y[go], equal[go]
        if not len(y):
            continue
        # Sets of similarity p differ in (1 - p) / (1 + p) of the sum of their sizes, their sketches in no more bits.
        y = y[(100 + percent) * sketch.differing(x, y) <= (100 - percent) * (size[x] + size[y])]
        if barred[x]:
            y = y[~np.isin(node[y], barred[x])]
        for other in y.tolist():
            if every:
                yield x, other
            elif part[other] != part[x]:
                yield x, other
                part[part == part[other]] = part[x]


def shingle_sets(docs: DataFrame, words: int, most_bits: int) -> DataFrame:
    """``doc_id, _row, node, size, signature, sketch`` of ``identified`` texts; ``node`` is a 64-bit hash of the whole set."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, minima, bits = [], [], [], []
            for text in batch.column("text"):
                values = shingles(text.as_py(), words)
                node.append(xxhash.xxh3_64_intdigest(values.tobytes()))
                size.append(len(values))
                minima.append(signature(values).tobytes())
                bits.append(parity(values, most_bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_row"), pa.array(np.array(node, np.uint64).view(np.int64)),
                 pa.array(size, pa.int64()), pa.array(minima, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "_row", "node", "size", "signature", "sketch"])

    return docs.select("doc_id", "_row", "text").mapInArrow(
        run, f"doc_id {kind}, _row long, node long, size long, signature binary, sketch binary")


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _bands(nodes: DataFrame) -> DataFrame:
    """``key, node``: one row for each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_signatures(batch.column("signature")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))],
                ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def meetings(nodes: DataFrame) -> DataFrame:
    """``key, node, members, low``: the members of each bucket with several, buckets of the same members once."""
    bands = _bands(nodes)
    buckets = bands.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("low"),
        F.expr("bit_xor(xxhash64(node))").alias("_h1"), F.expr("bit_xor(xxhash64(node, 1))").alias("_h2"))
    kept = buckets.where("members > 1").groupBy("members", "low", "_h1", "_h2").agg(F.min("key").alias("key"))
    return join_per_key(bands, kept.select("key", "members", "low"), ["key"])


def _whole_groups(batches: Iterator[pa.RecordBatch], group: list[str], most: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the places where groups begin and the end."""
    def breaks(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for c in group:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) >= most:
            new = breaks(held)
            if len(new):
                yield held.slice(0, int(new[-1])), np.r_[0, new]
                held = held.slice(int(new[-1])).combine_chunks()
    if held is not None and len(held):
        yield held, np.r_[0, breaks(held), len(held)]


def _proposals(rows: DataFrame, percent: int, cross: bool, every: bool) -> DataFrame:
    """``a, b, key``: what the buckets in ``rows`` (``key, node, members, low, root, barred`` and the set's columns) propose.

    Without ``cross`` only members of one slice meet, and the smallest of the bucket meets all.
    """
    slices = F.when(F.col("members") > SLICE, F.ceil(F.col("members") / (SLICE // 2))).otherwise(1).cast("int")
    rows = rows.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    every_slice = F.sequence(F.lit(0), F.col("slices") - 1)
    if cross:
        partners = F.transform(every_slice, lambda j: F.struct(F.least("slice", j).alias("i"), F.greatest("slice", j).alias("j")))
    else:
        own = F.when(F.col("node") == F.col("low"), every_slice).otherwise(F.array("slice"))
        partners = F.transform(own, lambda j: F.struct(j.alias("i"), j.alias("j")))
    meeting = rows.withColumn("pair", F.explode(partners)).select(
        "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "root", "size", "signature", "sketch", "barred",
        F.when(F.col("pair.i") == F.col("pair.j"), 3).when(F.col("slice") == F.col("pair.i"), 1).otherwise(2).alias("side"))
    least, group = least_matches(percent), ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, group):
            c = {k: table.column(k).to_numpy() for k in ("key", "node", "root", "size", "side")}
            minima, sketches = _signatures(table.column("signature")), table.column("sketch").to_pylist()
            barred = table.column("barred").to_pylist()
            a, b, key = [], [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                # The smallest nodes come first, so buckets of similar members propose the same edges.
                order = s + np.argsort(c["node"][s:e])
                found = list(surviving_pairs(
                    c["node"][order], c["root"][order], c["size"][order], minima[order], [sketches[k] for k in order],
                    c["side"][order], [barred[k] for k in order], percent, least, every))
                for x, y in found:
                    a.append(c["node"][order[x]])
                    b.append(c["node"][order[y]])
                    key.append(c["key"][s])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, key)], ["a", "b", "key"])

    return meeting.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, key long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b, linked`` for each of ``pairs``, decided on the full sets of ``texts`` (``node, text``)."""
    for side in ("a", "b"):
        pairs = join_per_key(pairs, texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), [side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def values(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                known[node] = shingles(text.as_py(), words)
            return known[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for k in range(batch.num_rows):
                x, y = values(a[k], batch.column("text_a")[k]), values(b[k], batch.column("text_b")[k])
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.mapInArrow(run, "a long, b long, linked boolean")


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: confirmed links that connect all ``nodes`` that links connect. ``docs`` is ``identified``."""
    met = scratch.table(meetings(nodes), "meetings")
    placed = join_per_key(nodes, met.select("node").distinct(), ["node"], "left_semi").select("doc_id", "_row", "node")
    found = join_rows(docs.select("doc_id", "_row", "text"), placed, "inner")
    texts = scratch.table(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    known = nodes.select("node", "size", "signature", "sketch")
    decided = None

    def proposed(cross: bool, every: bool, rows: DataFrame) -> DataFrame:
        k = len(scratch.paths)
        offers = scratch.table(_proposals(join_per_key(rows, known, ["node"]), percent, cross, every), f"offers{k}")
        verdict = scratch.table(_confirmed(offers.select("a", "b").distinct(), texts, words, percent), f"verdict{k}")
        return offers, verdict

    rows = met.withColumn("root", F.col("node")).withColumn("barred", F.array().cast("array<long>"))
    for cross, every in ((False, False), (True, False), (True, True)):
        offers, verdict = proposed(cross, every, rows)
        decided = verdict if decided is None else decided.unionByName(verdict)
        if every:
            break
        refuted = verdict.where("NOT linked").select("a", "b")
        again = join_per_key(offers, refuted, ["a", "b"], "left_semi").select("key").distinct()
        if not cross:
            again = again.unionByName(met.where(F.col("members") > SLICE).select("key")).distinct()
        if again.isEmpty():
            break
        rows = _open_buckets(met, again, decided, scratch)
    return decided.where("linked").select("a", "b")


def _open_buckets(met: DataFrame, again: DataFrame, decided: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the buckets ``again`` that still hold several components, with these and with the refuted partners."""
    roots = components(decided.where("linked").select("a", "b"), Scratch(met.sparkSession))
    rows = join_per_key(met, again, ["key"], "left_semi")
    rows = join_per_key(rows, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    barred = decided.where("NOT linked").groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("barred"))
    rows = join_per_key(join_per_key(rows, mixed, ["key"], "left_semi"), barred, ["node"], "left")
    return rows.withColumn("barred", F.coalesce("barred", F.array().cast("array<long>")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, _row, n_shingles, component_id`` for every row.

    Two texts are linked if ``percent`` of a hundred or more of their distinct ``words``-word shingles (ASCII case folded)
    are common; a text of fewer words is one shingle. ``component_id`` is the smallest ``doc_id`` reachable, the row's own
    included; rows without an id take part. Texts without a word (null, empty, blank) are linked with nothing; repeated
    rows get equal results; an empty table gives no rows.
    """
    scratch, texts = Scratch(docs.sparkSession), identified(docs)
    rows = scratch.table(shingle_sets(texts, words, most_bits), "sets")
    id_first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    nodes = scratch.table(
        rows.where("size > 0").groupBy("node").agg(
            F.min(id_first).alias("least"), *[F.first(c).alias(c) for c in ("size", "signature", "sketch")])
        .select("node", "size", "signature", "sketch", "least.doc_id", "least._row"), "distinct")
    roots = components(links(texts, nodes, words, percent, scratch), Scratch(docs.sparkSession)).withColumnRenamed("node", "found")
    rooted = nodes.join(roots, F.col("node") == F.col("found"), "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = join_per_key(rooted.select("node", "root"), smallest, ["root"]).select("node", "component_id")
    answer = Scratch(docs.sparkSession).table(
        join_per_key(rows.select("doc_id", "_row", "node", "size"), named, ["node"], "left").select(
            "doc_id", "_row", F.col("size").alias("n_shingles"),
            F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "components")
    scratch.drop()
    return answer


def component_digest(docs: DataFrame, words: int = 5, percent: int = 85, **options: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` (see ``near_duplicates``); a row without an id stays if no row of its group has one."""
    return near_duplicates(docs, words, percent, **options).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def remove_near_copies(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` with the row of the smallest ``doc_id`` of each group; groups without any id stay whole, repeated rows once."""
    kept = near_duplicates(docs, words, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "_row")
    first = Window.partitionBy("_row", "doc_id").orderBy(F.lit(1))
    rows = join_rows(carried(docs), kept.distinct(), "left_semi").withColumn("_nth", F.row_number().over(first))
    return restored(rows.where("_nth = 1"), docs)
