"""Merkle manifest of a table, one tree for each language under one root.

Every parent is hashed once, left to right, and keeps a copy of the hash state before each child slot (its midstates). To
fold a changed child, the state of its slot is resumed with the replacement and the siblings to its right; what stands to
its left is never hashed again.

A task builds subtrees of ``FANOUT ** LEVELS`` consecutive nodes, whose tops are the nodes of the next round. On the way
back each subtree gets the path from its top to the root, so no task holds more than one subtree and one path, however
many rows a language has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapspark.llm.common import Scratch, numbered
from lapspark.operators.joins import join_per_key

FANOUT = 8
#: Levels that one task builds: subtrees of 512 nodes.
LEVELS = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Parent:
    """A node with copies of its hash state before each child slot."""

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.midstates = children, []
        for child in children:
            self.midstates.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return b"".join(self.children[:slot])

    def right(self, slot: int) -> bytes:
        return b"".join(self.children[slot + 1:])


def resumed(midstate, replacement: bytes, right: bytes) -> bytes:
    """The digest of a parent from the state before a slot, what now stands there and the siblings after it."""
    state = midstate.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


class Subtree:
    """``levels`` levels over consecutive nodes (digests as hex text)."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels: list[list[Parent]] = []
        for _ in range(levels):
            self.levels.append([Parent(nodes[k:k + FANOUT]) for k in range(0, len(nodes), FANOUT)])
            nodes = [p.digest for p in self.levels[-1]]
        (self.top,) = nodes

    def path(self, place: int) -> Iterator[tuple[Parent, int]]:
        """The ancestors of a node inside the subtree, each with the slot the way goes through."""
        for parents in self.levels:
            place, slot = divmod(place, FANOUT)
            yield parents[place], slot


def _height(nodes: int) -> int:
    """Levels above so many nodes."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // FANOUT), height + 1
    return height


_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_BLOCK = ["key", "block"]


def _subtree(table: pa.Table, levels: int) -> tuple[pa.Table, Subtree]:
    table = table.sort_by("pos")
    levels = min(levels, _height(table.column("n")[0].as_py()))
    return table, Subtree([d.encode() for d in table.column("digest").to_pylist()], levels)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each subtree of ``nodes`` (``key, pos, n, digest``)."""
    def run(table: pa.Table) -> pa.Table:
        table, tree = _subtree(table, levels)
        n = table.column("n")[0].as_py()
        return pa.table({
            "key": table.column("key")[:1], "pos": table.column("block")[:1],
            "n": pa.array([-(-n // FANOUT ** levels)], pa.int64()), "digest": [tree.top.decode()]})

    return _blocks(nodes, levels).groupBy(*_BLOCK).applyInArrow(run, "key string, pos long, n long, digest string")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT ** levels))


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``key, block, path`` of every node (its ``pos`` is the block below), given the same of the subtrees ``nodes`` form."""
    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, tree = _subtree(table, levels)
        rest = upper.column("path")[0].as_py()
        path = [
            [{"left": p.left(s), "right": p.right(s)} for p, s in tree.path(i)] + rest for i in range(len(table))
        ]
        return pa.table({"key": table.column("key"), "block": table.column("pos"), "path": pa.array(path, _PATH)})

    return _blocks(nodes, levels).groupBy(*_BLOCK).cogroup(above.groupBy(*_BLOCK)).applyInArrow(
        run, "key string, block long, path array<struct<left:binary,right:binary>>")


class _Forest:
    """Rounds of subtrees over ``key, pos, n, digest`` until each key has one node."""

    def __init__(self, nodes: DataFrame, levels: int, scratch: Scratch, name: str):
        self.levels, self.scratch, self.name, self.rounds = levels, scratch, name, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.rounds.append(scratch.table(_tops(self.rounds[-1], levels), f"{name}{len(self.rounds)}"))
            most = -(-most // FANOUT ** levels)
        #: ``key, digest``
        self.tops = self.rounds[-1].select("key", "digest")

    def paths(self, above: DataFrame, down_to: int = 1) -> DataFrame:
        """``key, block, path`` of the subtrees of the nodes, or of the nodes themselves (0), given the paths of the tops."""
        found = above.select("key", F.lit(0).cast("long").alias("block"), "path")
        for k in range(len(self.rounds) - 1, down_to - 1, -1):
            found = self.scratch.table(_paths(self.rounds[k], found, self.levels), f"{self.name}-path{k}")
        return found


def _written(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_written(c) for c in ("doc_id", "source", "lang", "n_chars")], text), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``key, doc_id, digest, tampered``: the key sorts like the language, null first; ``tampered`` is null if equal."""
    text = F.col("text").cast("string")
    shifted = F.translate(text, _UPPER, _LOWER)
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (text != shifted)
    return docs.select(
        F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string"))).alias("key"),
        "doc_id",
        _leaf(_written("text")).alias("digest"),
        F.when(chosen, _leaf(F.concat(F.octet_length(shifted).cast("string"), F.lit(":"), shifted))).alias("tampered"),
    )


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf is the SHA-256 of ``doc_id, source, lang, n_chars, text``; null values (texts, languages, ids) are written
    ``-``, empty ones ``0:``. Rows ascend by id in their language, those without id first, rows of one id by their leaf;
    repeated rows are a leaf each. An empty table gives no rows; other columns are ignored. ``levels`` are built by one
    task and change no result.
    """
    scratch = Scratch(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = numbered(leaves(docs), "key", order, scratch, "leaves").withColumnsRenamed({"_pos": "pos", "_n": "n"})
    rows = scratch.table(rows, "numbered")
    scratch.drop("leaves")
    lower = _Forest(rows.select("key", "pos", "n", "digest"), levels, scratch, "tree")
    ordered = numbered(lower.tops.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "digest"),
                       "key", [F.col("lang_key")], scratch, "languages")
    tops = scratch.table(ordered.withColumnsRenamed({"_pos": "pos", "_n": "n"}), "subroots")
    upper = _Forest(tops.select("key", "pos", "n", "digest"), levels, scratch, "top")
    # The way of each language through the upper tree; the root itself has an empty one.
    start = upper.tops.select("key", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    way = upper.paths(start, down_to=0).select(F.col("block").alias("pos"), "path")
    named = tops.join(way, "pos").select(F.col("lang_key").alias("key"), F.col("digest").alias("subroot"), "path")
    above = join_per_key(lower.paths(named), named.select("key", "subroot"), ["key"])
    top = upper.tops.first()
    root = top.digest if top else ""
    kind = dict(docs.dtypes)["doc_id"]

    def run(table: pa.Table, over: pa.Table) -> pa.Table:
        table, tree = _subtree(table, levels)
        subroot = over.column("subroot")[0].as_py()
        rest = over.column("path")[0].as_py()
        # The midstates of the way above the subtree are the same for all its leaves.
        upper_way = [(hashlib.sha256(p["left"]), p["right"]) for p in rest]
        upper_siblings = b"".join(p["left"] + p["right"] for p in rest)
        proof, folded = [], []
        for place, (leaf, tampered) in enumerate(zip(table.column("digest").to_pylist(), table.column("tampered").to_pylist())):
            value, siblings = (tampered or leaf).encode(), hashlib.sha256()
            for parent, slot in tree.path(place):
                right = parent.right(slot)
                siblings.update(parent.left(slot))
                siblings.update(right)
                value = resumed(parent.midstates[slot], value, right)
            siblings.update(upper_siblings)
            for midstate, right in upper_way:
                value = resumed(midstate, value, right)
            proof.append(siblings.hexdigest())
            folded.append(value.decode())
        n = len(table)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("digest"),
            "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    return _blocks(rows, levels).groupBy(*_BLOCK).cogroup(above.groupBy(*_BLOCK)).applyInArrow(
        run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
