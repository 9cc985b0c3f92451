"""SimHash near-duplicates: fingerprints, BK-trees of shards of them, and the components they link."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, drop_rows, hash_pair, join_frequent, map_batches, named
from itemrec.llm.components import components, forest
from itemrec.runtime import store

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints of one tree at most; a shard with more is cut into several trees.
TREE_SIZE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    shingles = map(line.__getitem__, map(slice, [0, *ends[:-width].tolist()], (ends - 1)[width - 1 :].tolist()))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> dict[str, object]:
    found = np.array([fingerprint(t or b"") for t in batch["text"].to_pylist()], np.uint64)
    return {c: batch[c] for c in ("doc_id", "h1", "h2")} | {"fp": found.view(np.int64)}


class BKTree:
    """Distinct fingerprints by Hamming distance: a node's child at edge d is at distance d of it.

    The tree is built and searched level by level: all fingerprints that meet at a node are
    compared with it at once, and go on to the child at their distance.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        below = np.arange(1, len(values), dtype=np.int32)
        at = np.zeros(len(below), np.int32)
        while len(below):
            edge = np.bitwise_count(values[below] ^ values[at])
            free = self.child[at, edge] < 0
            # Of those that come to a free place, the first is the child there.
            self.child[at[free][::-1], edge[free][::-1]] = below[free][::-1]
            at = self.child[at, edge]
            on = at != below
            below, at = below[on], at[on]

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) numbers at a distance of at most ``radius``, following only the edges that may lead there."""
        left, right = [], []
        for block in np.array_split(np.arange(len(queries), dtype=np.int32), len(queries) // 2_048 + 1):
            query, node = block, np.zeros(len(block), np.int32)
            while len(query):
                far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int32)
                hit = far <= radius
                left.append(query[hit])
                right.append(node[hit])
                nexts, froms = [], []
                for step in range(-radius, radius + 1):
                    edge = far + step
                    inside = (edge > 0) & (edge <= 64)
                    child = self.child[node[inside], edge[inside]]
                    there = child >= 0
                    nexts.append(child[there])
                    froms.append(query[inside][there])
                query, node = np.concatenate(froms), np.concatenate(nexts)
        return np.concatenate(left), np.concatenate(right)


def _search(values: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links of ``values`` with the fingerprints in ``tree`` do."""
    if not len(tree):  # the hash has put no fingerprint of the shard here
        return tree, tree
    query, node = BKTree(tree).pairs(values, radius)
    a, b = values[query], tree[node]
    new = a != b
    return forest(a[new], b[new])


def links(fingerprints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as far as links within ``radius`` bits do.

    Of ``radius + 1`` bands of the bits, two such fingerprints share one. So a band's value is a
    shard: its fingerprints are built into a BK-tree and look each other up in it. A shard of over
    ``tree_size`` fingerprints becomes several trees, and its fingerprints go to each of them.
    """
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])
    placed = fingerprints.select("fp", F.explode(bands).alias("x")).select("x.band", "x.value", "fp")
    sizes = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("trees", F.ceil(F.col("n") / tree_size))
    sized = placed.join(sizes.select("band", "value", "trees"), ["band", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("trees"))
    looked = sized.select("band", "value", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("trees") - 1)).alias("tree"), "fp", own.alias("own"))
    looked = looked.select("band", "value", "tree", "fp", (F.col("own") == F.col("tree")).alias("in_tree"))
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = looked.repartition(n, "band", "value", "tree").sortWithinPartitions("band", "value", "tree", F.desc("in_tree"))
    out = arrow_schema("a bigint, b bigint")

    def found(values: np.ndarray, tree: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _search(values.view(np.uint64), tree.view(np.uint64), radius)
        yield as_batch({"a": a.view(np.int64), "b": b.view(np.int64)}, out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come in order; those of a tree come first, then what only looks it up."""
        key, tree, waiting = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "value", "tree")])
            fps, inside = batch["fp"].to_numpy(), batch["in_tree"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(keys[:, a].tolist())) != key:
                    if key is not None:
                        nodes = np.concatenate(tree)
                        yield from found(np.concatenate([nodes, *waiting]), nodes)
                    key, tree, waiting = now, [], []
                part, mask = fps[a:b], inside[a:b]
                tree.append(part[mask])
                waiting.append(part[~mask])
                if sum(map(len, waiting)) > 16 * tree_size:
                    yield from found(np.concatenate(waiting), np.concatenate(tree))
                    waiting = []
        if key is not None:
            nodes = np.concatenate(tree)
            yield from found(np.concatenate([nodes, *waiting]), nodes)

    bound_batches(fingerprints.sparkSession)
    return ordered.mapInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; a component is what links within ``radius`` bits connect.

    ``fingerprint`` is in 16 hexadecimal digits, ``component_id`` the smallest id of the component.
    Null, empty and blank texts have fingerprint zero and link like any other. A text of fewer than
    three words is one shingle. Repeated rows each yield a row. Null ids are members, but don't
    count for the smallest id unless a component has no other. No rows give no rows; other columns
    are ignored.
    """
    found = grouped(docs, id_col, text_col, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is their component's, as they are; of rows of equal id and text, one."""
    found = store(grouped(docs, id_col, text_col, radius).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    left = drop_rows(docs, found.where("not stays"), id_col, text_col)
    if found.where("stays").groupBy("doc_id", "h1", "h2").count().where("count > 1").isEmpty():
        return left
    return left.dropDuplicates([id_col, text_col])


def grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, h1, h2, fp, component_id) for each row; the hashes tell rows of one id apart."""
    rows = docs.select(
        named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"),
        *[h.alias(n) for h, n in zip(hash_pair(F.coalesce(named(text_col), F.lit(""))), ("h1", "h2"), strict=True)],
    )
    held = store(map_batches(rows, _fingerprints, "doc_id bigint, h1 bigint, h2 bigint, fp bigint"))
    unique = store(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    linked = components(links(unique.select("fp"), radius))
    named_by = (
        unique.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    least = named_by.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = named_by.select("fp", "root", "n_rows").join(least, "root").select("fp", "component_id", "n_rows")
    return join_frequent(held, roots, ["fp"], "n_rows", held.count())
