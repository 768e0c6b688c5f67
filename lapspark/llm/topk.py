"""Exact top-k inner products by distributed histogram selection.

Vectors become integers, so scores are exact. Queries and candidates are packed into blocks; each pair of blocks is
scored by one matrix product, and no pair of vectors ever becomes a row. Every pass scores everything: histogram passes
narrow, for all queries together, the interval that holds the k-th best score until it is one value; the last pass keeps
what lies above it and the smallest ids among its ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapspark.llm.common import Scratch

BINS = 4096
#: Scores held at once in a task.
CELLS = 1 << 21
#: Candidate blocks that one copy of the queries may serve.
GROUP = 16
#: Vectors of at least this length are scored in wide integers: products of shorter ones fit 64 bits.
WIDE = 1 << 30
#: Largest number of a score column of 38 digits.
DIGITS = 10**38 - 1
OWN = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: components ``floor(scale * x)``; vectors that are null, hold null or are not finite are left out."""
    real = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select("vec_id", real.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
        .where(~F.coalesce(bad, F.lit(False)))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def _blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """``name, name_ids, name_data``: vectors packed into ``count`` blocks by a hash of id and components.

    The rows of one id are spread over the blocks, so an id that holds a third of all rows fills no block alone.
    """
    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        return pa.table({
            name: table.column("_b").slice(0, 1), "dim": table.column("dim").slice(0, 1),
            f"{name}_ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()]),
            f"{name}_data": pa.array([v.flatten().to_numpy().astype("<i8").tobytes()]),
        })

    return (
        vectors.withColumn("_b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)))
        .groupBy("_b", "dim").applyInArrow(pack, f"{name} long, dim int, {name}_ids binary, {name}_data binary")
    )


def _scored(pairs: DataFrame, use: Callable, schema: str, exact_double: bool) -> DataFrame:
    """``use(query ids, candidate ids, scores, states, query block)`` over all pairs of blocks.

    A query's own place holds the smallest integer, which no score reaches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()
                q_ids = np.frombuffer(get("q_ids"), "<i8")
                c_ids = np.frombuffer(get("c_ids"), "<i8")
                queries = np.frombuffer(get("q_data"), "<i8").reshape(len(q_ids), -1)
                candidates = np.frombuffer(get("c_data"), "<i8").reshape(len(c_ids), -1)
                if exact_double:
                    queries, candidates = queries.astype(np.float64), candidates.astype(np.float64)
                state = np.frombuffer(get("state"), "<i8").reshape(len(q_ids), -1)
                step = max(1, CELLS // len(c_ids))
                for s in range(0, len(q_ids), step):
                    some = slice(s, s + step)
                    scores = (queries[some] @ candidates.T).astype(np.int64)
                    scores[q_ids[some, None] == c_ids[None, :]] = OWN
                    yield from use(q_ids[some], c_ids, scores, state[some], get("q"))

    return pairs.mapInArrow(run, schema)


def _histogram(k: int) -> Callable:
    """Counts of scores per bin of each query's interval, down to the k-th score of the block.

    Scores below that one cannot be the k-th of all candidates, so they are not sent.
    """
    def use(q_ids, c_ids, scores, state, block):
        best = np.partition(scores, -k, axis=1)[:, -k:].min(axis=1) if scores.shape[1] > k else np.full(len(q_ids), OWN)
        query, place = np.nonzero((scores >= best[:, None]) & (scores >= state[:, :1]) & (scores > OWN))
        low, width = state[query, 0], state[query, 1]
        # Scores far above the interval share the last bin.
        bins = np.minimum((scores[query, place] - low) // width, BINS)
        key, count = np.unique(query * (BINS + 1) + bins, return_counts=True)
        if len(key):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), block)), pa.array(q_ids[key // (BINS + 1)]), pa.array(key % (BINS + 1)), pa.array(count)],
                ["q", "query_id", "bin", "n"])

    return use


def _selected(k: int) -> Callable:
    """Scores over the query's threshold, and of those equal to it the k smallest ids."""
    def use(q_ids, c_ids, scores, state, block):
        at, who, score = [], [], []
        for i in range(len(q_ids)):
            over = np.flatnonzero(scores[i] > state[i, 0])
            ties = np.flatnonzero(scores[i] == state[i, 0])
            if len(ties) > k:
                ties = ties[np.argpartition(c_ids[ties], k - 1)[:k]]
            found = np.r_[over, ties]
            at.append(np.full(len(found), q_ids[i]))
            who.append(c_ids[found])
            score.append(scores[i][found])
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (at, who, score)], ["query_id", "vec_id", "score"])

    return use


def _stateful(queries: DataFrame, states: DataFrame) -> DataFrame:
    """Query blocks with the numbers of their queries in ``state``, in the order of their ids.

    ``states`` has one row for each block, ``q, ids, values``; a block has a bounded number of queries.
    """
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column("q_ids")[row].as_py(), "<i8")
                known = batch.column("listed")[row].as_py()
                values = {x["query_id"]: (x["low"], x["width"]) for x in known}
                packed.append(np.array([values.get(i, (np.iinfo(np.int64).max // 4, 1)) for i in ids.tolist()], "<i8").tobytes())
            yield batch.drop_columns(["listed"]).append_column("state", pa.array(packed, pa.binary()))

    listed = states.groupBy("q").agg(F.collect_list(F.struct("query_id", "low", "width")).alias("listed"))
    return queries.hint("merge").join(listed, "q").mapInArrow(
        order, "q long, dim int, q_ids binary, q_data binary, state binary")


def _pairs(queries: DataFrame, candidates: DataFrame, blocks: int) -> DataFrame:
    """Every query block with every candidate block of its dimension.

    Queries are copied to groups of candidate blocks and both are shuffled by group. A broadcast, which small files or few
    copies invite, would bring all copies to the driver. Small tables have a group for each block, to keep all cores busy.
    """
    groups = max(-(-blocks // GROUP), min(blocks, 4 * queries.sparkSession.sparkContext.defaultParallelism))
    copied = queries.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return copied.hint("merge").join(candidates.withColumn("g", F.col("c") % groups).hint("merge"), ["g", "dim"])


def _as_long(name: str) -> Column:
    """The nearest 64-bit number."""
    ends = np.iinfo(np.int64)
    return F.least(F.greatest(name, F.lit(ends.min)), F.lit(ends.max)).cast("long").alias(name)


def _wide_hits(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of pairs that may leave 64 bits: the ``k`` best of each query row and block."""
    blocks = max(1, -(-candidates.count() // 512))
    asked = _blocks(queries, max(1, -(-queries.count() // 512)), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: np.frombuffer(batch.column(c)[row].as_py(), "<i8")
                q_ids, c_ids = get("q_ids"), get("c_ids").tolist()
                whole = get("c_data").reshape(len(c_ids), -1).astype(object).T
                found = []
                for own, vector in zip(q_ids.tolist(), get("q_data").reshape(len(q_ids), -1).astype(object)):
                    scores = zip((vector @ whole).tolist(), c_ids)
                    best = nsmallest(k, ((-score, other) for score, other in scores if other != own))
                    found += [(own, other, Decimal(max(-DIGITS, min(DIGITS, -minus)))) for minus, other in best]
                if found:
                    own, other, score = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.decimal128(38, 0))],
                        ["query_id", "vec_id", "score"])

    return _pairs(asked, _blocks(candidates, blocks, "c"), blocks).mapInArrow(
        run, "query_id long, vec_id long, score decimal(38,0)")


def top_k(vectors: DataFrame, k: int = 10, is_query: Column | None = None, query_block: int = 512,
          candidate_block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` highest scores, ties to the smaller id.

    Queries are the rows whose ``vec_id`` is divisible by 100 unless ``is_query`` says otherwise; a query is no
    candidate of its own. Rows without ``vec_id`` take no part. Fewer candidates than ``k`` give all of them. Vectors of
    different lengths never meet; unusable vectors take no part (see ``integer_vectors``). Every row with a vector of its
    own is a candidate, also under a repeated ``vec_id`` (the hits of one ``query_id`` are ranked together); rows equal
    in id and vector count once. An empty table gives no rows.

    Pairs with a vector of length ``WIDE`` or more are scored apart, in integers of any size. They are ranked by up to 38
    digits and returned as the nearest 64-bit number. Components beyond 64 bits count as the nearest such number.
    """
    scratch = Scratch(vectors.sparkSession)
    clean = integer_vectors(vectors.select("vec_id", "embedding").distinct())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    every = scratch.table(clean.withColumns({"dim": F.size("v"), "wide": norm >= WIDE}), "vectors")
    asks = (F.col("vec_id") % 100 == 0) if is_query is None else is_query
    table = every.where(~F.col("wide"))
    chosen = table.where(asks)
    n, longest = table.agg(F.count("*"), F.max(norm)).first()
    blocks = max(1, -(-n // candidate_block))
    queries = scratch.table(_blocks(chosen, max(1, -(-chosen.count() // query_block)), "q"), "queries")
    candidates = scratch.table(_blocks(table, blocks, "c"), "candidates")
    bound = int((longest or 0.0) ** 2 * (1 + 1e-9)) + 1
    exact_double = bound < 1 << 53

    def pairs(states: DataFrame) -> DataFrame:
        # Queries are the hundredth part, so they are the side that is copied.
        return _pairs(_stateful(queries, states), candidates, blocks)

    ids = queries.mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays([pa.array(np.full(len(x), q)), pa.array(x)], ["q", "query_id"])
            for b in batches for q, x in zip(b.column("q").to_pylist(), (np.frombuffer(v.as_py(), "<i8") for v in b.column("q_ids")))
        ), "q long, query_id long").distinct()
    width = -(-(2 * bound + 1) // BINS)
    state = scratch.table(ids.withColumns({"low": F.lit(-bound).cast("long"), "width": F.lit(width).cast("long")}), "interval0")
    step = 0
    while True:
        counts = _scored(pairs(state), _histogram(k), "q long, query_id long, bin long, n long", exact_double).groupBy("q", "query_id", "bin").agg(
            F.sum("n").alias("n"))
        # The bin in which the running count from above reaches k; with fewer candidates the lowest one.
        down = Window.partitionBy("q", "query_id").orderBy(F.desc("bin"))
        running = counts.withColumn("upto", F.sum("n").over(down)).withColumn("before", F.col("upto") - F.col("n"))
        found = running.where(F.col("before") < k).groupBy("q", "query_id").agg(F.min("bin").alias("bin"))
        inner = -(-width // BINS)
        state = scratch.table(
            found.join(state, ["q", "query_id"]).select(
                "q", "query_id", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.lit(inner).cast("long").alias("width")),
            f"interval{step + 1}")
        step += 1
        if width == 1:
            break
        width = inner
    hits = _scored(pairs(state), _selected(k), "query_id long, vec_id long, score long", exact_double)
    wide = every.where("wide")
    if not wide.isEmpty():
        hits = hits.withColumn("score", F.col("score").cast("decimal(38,0)"))
        hits = hits.unionByName(_wide_hits(wide.where(asks), every, k)).unionByName(_wide_hits(chosen, wide, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", _as_long("score"))
