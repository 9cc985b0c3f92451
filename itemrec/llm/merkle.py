"""Merkle manifest of a table: trees of eight-way nodes, and versions of them with one leaf changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, named
from itemrec.operators.ranking import ranked
from itemrec.runtime import store

FANOUT = 8
#: Levels that one task builds at a time: a block is an aligned run of FANOUT ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, pos bigint, n bigint, digest binary"
PATHS = "tree string, block bigint, pos bigint, path array<binary>, subroot binary, root binary"
RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest_of(nodes: list[bytes]) -> bytes:
    """The digest of a run: sha256 of its digests as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def levels_above(n: int) -> int:
    """How often runs of eight must be put together until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Block:
    """An aligned block of a tree, as a store of nodes that only grows.

    Node i has ``digests[i]`` and the nodes ``below[i]``. A version with another leaf adds that leaf
    and a copy of each of its ancestors in the block; every other node is shared with the first version.
    """

    def __init__(self, leaves: list[bytes], levels: int):
        self.digests, self.below = list(leaves), [()] * len(leaves)
        self.rows = [list(range(len(leaves)))]
        for _ in range(levels):
            last = self.rows[-1]
            self.rows.append([self.add(last[a : a + FANOUT]) for a in range(0, len(last), FANOUT)])

    def add(self, below: list[int]) -> int:
        self.digests.append(digest_of([self.digests[i] for i in below]))
        self.below.append(tuple(below))
        return len(self.digests) - 1

    @property
    def root(self) -> int:
        return self.rows[-1][0]

    def version(self, at: int, leaf: bytes) -> int:
        """Root of the version in which leaf number ``at`` is ``leaf``."""
        node = len(self.digests)
        self.digests.append(leaf)
        self.below.append(())
        for row in self.rows[1:]:
            place, at = at % FANOUT, at // FANOUT
            below = list(self.below[row[at]])
            below[place] = node
            node = self.add(below)
        return node

    def runs(self, at: int, level: int) -> tuple[int, list[bytes]]:
        """(place in the run, digests of the run) of leaf ``at``'s ancestor at ``level``."""
        row, at = self.rows[level], at // FANOUT**level
        first = at - at % FANOUT
        return at - first, [self.digests[i] for i in row[first : first + FANOUT]]

    def path(self, at: int, first: int = 0) -> list[bytes]:
        """The runs on the way up from ``first``, each as its place and its digests in one string."""
        return [bytes([place]) + b"".join(run) for place, run in (self.runs(at, level) for level in range(first, len(self.rows) - 1))]


def siblings(step: bytes) -> bytes:
    """Hexadecimal text of the other digests of a run on a path."""
    at = 1 + 32 * step[0]
    return (step[1:at] + step[at + 32 :]).hex().encode()


def continued(digest: bytes, path: list[bytes]) -> bytes:
    """The root of the version in which the node below ``path`` has ``digest``: a copy of each ancestor."""
    for step in path:
        at = 1 + 32 * step[0]
        digest = hashlib.sha256((step[1:at] + digest + step[at + 32 :]).hex().encode()).digest()
    return digest


def _by_block(nodes: DataFrame, levels: int) -> DataFrame:
    block = F.floor(F.col("pos") / FANOUT**levels)
    placed = nodes.withColumn("block", F.when(F.col("pos") < 0, F.col("block")).otherwise(block) if "block" in nodes.columns else block)
    return placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, dict[str, list]]]:
    """(tree, block, its rows by column) for sorted rows: what is held is one block and one batch."""
    key, held = None, None
    for batch in batches:
        columns = {c: batch[c].to_pylist() for c in batch.schema.names}
        keys = list(zip(columns["tree"], columns["block"], strict=True))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if held is not None and key == keys[start]:
                for c, v in columns.items():
                    held[c] += v[start:end]
            else:
                if held is not None:
                    yield *key, held
                key, held = keys[start], {c: v[start:end] for c, v in columns.items()}
            start = end
    if held is not None:
        yield *key, held


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` levels up, or as many as there are: one for each block."""
    out, size = arrow_schema(NODES), FANOUT**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in _blocks(batches):
            n = rows["n"][0]
            built = Block(rows["digest"], min(levels, levels_above(n)))
            yield as_batch({"tree": [tree], "pos": [block], "n": [-(-n // size)], "digest": [built.digests[built.root]]}, out)

    bound_batches(nodes.sparkSession)
    return _by_block(nodes.select("tree", "pos", "n", "digest"), levels).mapInArrow(run, NODES)


def _with_heads(nodes: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """Nodes by block, each block led by a row with the path of its root and the digests above it."""
    return _by_block(nodes.withColumn("block", F.lit(None).cast("bigint")).unionByName(heads.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True), levels)


def descend(nodes: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """The path of every node, from those of the blocks' roots; a node's ``pos`` is a block of the level below."""
    out = arrow_schema(PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, rows in _blocks(batches):
            built, above = Block(rows["digest"][1:], min(levels, levels_above(rows["n"][1]))), rows["path"][0]
            at = range(len(rows["pos"]) - 1)
            columns = {"path": [built.path(i) + above for i in at]} | {c: [rows[c][0]] * len(at) for c in ("subroot", "root")}
            yield as_batch(columns | {"tree": [tree] * len(at), "block": rows["pos"][1:], "pos": [-1] * len(at)}, out)

    bound_batches(nodes.sparkSession)
    return _with_heads(nodes.select("tree", "pos", "n", "digest"), heads, levels).mapInArrow(run, PATHS)


def _finish(leaves: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """Proof and verdict of every leaf; a changed one is a version of its block, continued above it."""
    out = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _blocks(batches):
            digests, above = rows["digest"][1:], rows["path"][0]
            subroot, root = rows["subroot"][0], rows["root"][0]
            built = Block(digests, min(levels, levels_above(rows["n"][1])))
            own = len(built.rows) - 1
            upper = b"".join(map(siblings, above))
            unchanged = continued(built.digests[built.root], above)
            proofs, folded, rest = [], [], upper
            for i, other in enumerate(rows["other"][1:]):
                if own and i % FANOUT == 0:
                    rest = b"".join(map(siblings, built.path(i, 1))) + upper
                place, beside = built.runs(i, 0) if own else (0, digests)
                proofs.append(hashlib.sha256((b"".join(beside[:place] + beside[place + 1 :]).hex().encode() if own else b"") + rest).hexdigest())
                folded.append(unchanged if other is None else continued(built.digests[built.version(i, other)], above))
            yield as_batch(
                {"doc_id": rows["doc_id"][1:], "leaf": [d.hex() for d in digests], "subroot": [subroot.hex()] * len(digests), "root": [root.hex()] * len(digests),
                 "proof_sha256": proofs, "folded_root": [f.hex() for f in folded], "verified": [f == root for f in folded]}, out,
            )

    bound_batches(leaves.sparkSession)
    return _with_heads(leaves, heads, levels).mapInArrow(run, RESULT)


def _levels_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and what is above them, block by block, until every tree has one node."""
    tables = [nodes]
    n = nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        tables.append(store(climb(tables[-1], levels)))
        n = -(-n // FANOUT**levels)
    return tables


def manifest(
    docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
    tampered: Column | None = None, changes: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """A leaf, its proof and its verdict for each row of ``docs``.

    A leaf is the digest of ``fields``. The leaves of a value of ``tree_col`` ascend by ``id_col``;
    eight by eight they become nodes until one is left, the subroot, and the subroots, in the order of
    their values, likewise become the root. ``proof_sha256`` is the digest of all siblings on the way
    up. Rows for which ``tampered`` holds are made again with ``changes`` in place of fields:
    ``folded_root`` is the root of the version with that leaf alone changed, and ``verified`` tells
    whether it equals the root. A task builds ``levels`` levels of a tree at a time.

    Every null field is part of its leaf. A null value of ``tree_col`` is a tree of its own, before all
    others. Null ids come first; rows of one id in a tree are ordered by their digests, so equal rows
    have equal leaves. A row alone in the table is leaf, subroot and root, with an empty proof. No rows
    give no rows. Other columns are ignored, whatever their names.
    """
    columns = {f: named(f) for f in fields}
    other = F.when(tampered, F.unhex(leaf_digest(list((columns | (changes or {})).values())))) if tampered is not None else F.lit(None).cast("binary")
    leaves = store(docs.select(
        named(id_col).cast("bigint").alias("doc_id"), named(tree_col).cast("string").alias("tree"), F.unhex(leaf_digest(list(columns.values()))).alias("digest"), other.alias("other"),
    ))
    placed = ranked(leaves, ["tree"], [F.asc_nulls_first("doc_id"), F.asc("digest")], "pos", "n").withColumn("pos", F.col("pos") - 1)
    own = _levels_of(store(placed), levels)
    subroots = store(own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    tops = _levels_of(store(ranked(subroots, ["tree"], [F.asc_nulls_first("name")], "pos", "n").withColumn("pos", F.col("pos") - 1)), levels)
    heads = tops[-1].select("tree", F.col("pos").alias("block"), F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for table in reversed(tops):
        heads = store(descend(table, heads.drop("pos"), levels))
    named_by = heads.select(F.col("block").alias("pos"), "path", "root").join(tops[0].select("pos", "name", "digest"), "pos")
    heads = named_by.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    for table in reversed(own[1:]):
        heads = store(descend(table, heads.drop("pos"), levels))
    return _finish(own[0], heads.drop("pos"), levels)
