"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemrec.llm.common import UPPER, LOWER, arrow_schema, as_batch, bound_batches, named, without

WINDOW, SHINGLE = 13, 3
#: Words of benchmark text that one index holds, so that a shingle's number fits 64 bits. A larger
#: benchmark becomes several indexes, which every batch of documents passes one after the other.
INDEX_WORDS = 2_000_000
ADDED = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
_OTHER = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
#: Letters to lower case, and what isn't a letter, digit or beyond ASCII to a space.
TABLE = bytes.maketrans(UPPER.encode() + _OTHER, LOWER.encode() + b" " * len(_OTHER))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Index:
    """The windows of some items, by number.

    Words have numbers from 1, other words are 0. A shingle is up to ``SHINGLE`` words in a row,
    written as one number. ``choose`` orders a window's shingles by rarity; as a document has to
    hold all of a window, its rarest shingle alone is the prefix that it needs.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        spans: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            for i in range(max(1, len(ids) - WINDOW + 1)):
                if ids:
                    spans.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.base = len(number) + 1
        self.windows = [np.array(w) for w in spans]
        self.items = [sorted(x) for x in spans.values()]
        # Shingles as long as there are, but not longer than the shortest window.
        self.width = min([SHINGLE, *map(len, self.windows)]) if self.windows else SHINGLE
        self.keys = np.unique(np.concatenate([self.shingles(w) for w in self.windows])) if self.windows else np.zeros(0, np.int64)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter(map(get, words, repeat(0)), np.int64, len(words))

    def shingles(self, ids: np.ndarray) -> np.ndarray:
        """A number for each shingle; 0 where it has a word that no item has."""
        n = max(0, len(ids) - self.width + 1)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(self.width):
            part = ids[i : i + n]
            key = key * self.base + part
            known &= part > 0
        return np.where(known, key, 0)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the shingle among ``keys``) for each shingle of a document that an item has too."""
        found = self.shingles(ids)
        at = np.flatnonzero(found)
        if not len(at):
            return at, at
        rank = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        same = self.keys[rank] == found[at]
        return at[same], rank[same]

    def choose(self, times: np.ndarray) -> None:
        """Key each window by the shingle that documents hold least often."""
        for w, ids in enumerate(self.windows):
            ranks = np.searchsorted(self.keys, self.shingles(ids))
            offset = int(np.argmin(times[ranks]))
            self.prefixes.setdefault(int(ranks[offset]), []).append((w, offset))

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(place, window) of each window that the document holds."""
        out, n = [], len(ids)
        for place, rank in zip(*(x.tolist() for x in self.places(ids)), strict=True):
            for w, offset in self.prefixes.get(rank, ()):
                window, start = self.windows[w], place - offset
                # By length and position: the whole window must lie in the document.
                if start >= 0 and start + len(window) <= n and (ids[start : start + len(window)] == window).all():
                    out.append((start, w))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, as many at a time as an index may hold."""
    block, size = [], 0
    for row in benchmark.select(named(item_col).cast("string").alias("item"), named(text_col).cast("binary").alias("text")).toLocalIterator():
        words = words_of(row.text)
        if words:
            block.append((row.item or "", words))
            if (size := size + len(words)) >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _rarity(rows: DataFrame, index: Index) -> np.ndarray:
    """How often documents hold each shingle of the index."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    out = arrow_schema("rank bigint, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        times = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                times += np.bincount(own.places(own.numbers(words_of(text)))[1], minlength=len(times))
        at = np.flatnonzero(times)
        yield as_batch({"rank": at, "n": times[at]}, out)

    found = rows.mapInArrow(count, "rank bigint, n bigint").groupBy("rank").agg(F.sum("n").alias("n"))
    times = np.zeros(len(index.keys), np.int64)
    for row in found.toLocalIterator():
        times[row.rank] = row.n
    shared.unpersist()
    return times


def mark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated.

    Words are runs of ASCII letters, in lower case, digits and characters beyond ASCII. A window is
    13 words of an item in a row, or all words of a shorter one. A document's word is hit if it lies
    in an occurrence of a window, and a document is contaminated if a twentieth of its words are hit.

    Null or wordless texts have no words and no hits; items without words have no window. Items with
    equal windows all count; a null item id counts as ''. Repeated rows each yield a row. No rows
    give no rows; with an empty benchmark nothing is hit. Other columns pass through, but those
    named like the added ones are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rest = without(docs, ADDED)
    bytes_only, indexes = docs.select(named(text_col).cast("binary").alias("text")), []
    for block in _blocks(benchmark, item_col, item_text_col, index_words):
        index = Index(block)
        index.choose(_rarity(bytes_only, index))
        indexes.append(spark.sparkContext.broadcast(index))
    schema = T.StructType([
        *rest.schema.fields, *[T.StructField(c, T.LongType(), False) for c in ADDED[:3]],
        T.StructField("item_ids", T.ArrayType(T.StringType(), False), False), T.StructField("contaminated", T.BooleanType(), False),
    ])
    out, passed = arrow_schema(schema), rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch[text_col].cast(pa.binary()).to_pylist()]
            edges = [np.zeros(len(w) + 1, np.int64) for w in words]
            items: list[set[str]] = [set() for _ in words]
            for shared in indexes:
                index = shared.value
                for i, own in enumerate(words):
                    for start, w in index.hits(index.numbers(own)):
                        edges[i][start] += 1
                        edges[i][start + len(index.windows[w])] -= 1
                        items[i].update(index.items[w])
            added: dict[str, list] = {c: [] for c in ADDED}
            for own, edge, found in zip(words, edges, items, strict=True):
                hit = int((edge.cumsum() > 0).sum()) if found else 0
                for c, v in zip(ADDED, (len(own), hit, len(found), sorted(found), hit > 0 and 20 * hit >= len(own)), strict=True):
                    added[c].append(v)
            yield as_batch({c: batch[c] for c in passed} | added, out)

    return rest.mapInArrow(run, schema)


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)
