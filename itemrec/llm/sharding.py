"""Sharding by histogram sort: shards of equal bytes, each a range of keys in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, fresh, named, without
from itemrec.runtime import store

ADDED = ("shard", "slot")
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Keys probed for each splitter in the first round, and keys probed in all at most in a later one.
PROBES_EACH, PROBES_MOST = 64, 1 << 16
#: Bytes that one task sorts: shards are exchanged and sorted in parts of this size.
PART_BYTES = 64 << 20
KEY = ("k1", "id", "k2")
WIDTH = 25


def digest_part(text: Column, at: int) -> Column:
    """60 bits of the text's md5 as a long."""
    return F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def packed(k1: np.ndarray, ids: np.ndarray, known: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Keys as byte strings that compare like (k1, null ids first, id, k2)."""
    out = np.zeros((len(k1), WIDTH), np.uint8)
    out[:, :8] = k1.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = known
    shifted = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 9:17] = np.where(known, shifted, 0).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 17:] = k2.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view(f"S{WIDTH}").ravel()


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch["id"]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return packed(batch["k1"].to_numpy(), ids.fill_null(0).to_numpy(), known, batch["k2"].to_numpy())


def _probes(keys: DataFrame, inside: list[tuple[bytes, bytes]] | None, share: float) -> np.ndarray:
    """The distinct keys of a share of the rows, chosen by hash: of all, or of those in the intervals (from, to)."""
    cut = int(share * 1_000_000)
    rows = keys if share >= 1 else keys.where(F.pmod(F.xxhash64("k2", "id"), F.lit(1_000_000)) < cut)
    lows, highs = (np.array([x[i] for x in inside], f"S{WIDTH}") for i in (0, 1)) if inside is not None else (None, None)
    out = arrow_schema("key binary")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _keys(batch)
            if lows is not None:
                at = np.searchsorted(highs, own, side="right")
                near = at < len(highs)
                own = own[near][own[near] > lows[at[near]]]
            yield as_batch({"key": [k.ljust(WIDTH, b"\0") for k in np.unique(own).tolist()]}, out)

    found = rows.mapInArrow(take, "key binary").distinct().collect()
    return np.array(sorted(bytes(r.key) for r in found), f"S{WIDTH}")


def _below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes with keys below each probe; a last entry has those of all."""
    out = arrow_schema("bucket bigint, n bigint, bytes bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(probes) + 1), np.int64)
        for batch in batches:
            at = np.searchsorted(probes, _keys(batch), side="right")
            sums[0] += np.bincount(at, minlength=len(probes) + 1)
            np.add.at(sums[1], at, batch["size"].to_numpy())
        full = np.flatnonzero(sums[0])
        yield as_batch({"bucket": full, "n": sums[0][full], "bytes": sums[1][full]}, out)

    sums = np.zeros((2, len(probes) + 1), np.int64)
    for row in keys.mapInArrow(count, "bucket bigint, n bigint, bytes bigint").groupBy("bucket").agg(F.sum("n"), F.sum("bytes")).collect():
        sums[:, row[0]] = row[1:]
    return tuple(sums.cumsum(axis=1))


def splitters(keys: DataFrame, n_shards: int, part_bytes: int, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probes, rows below each, bytes below each, number of the probe at which each shard but the first begins).

    A shard's splitter is the least key with its share of the bytes below it. Every round counts
    exactly what is below each probe, and the splitter lies between the last probe with less below
    it and the next. It is met if that one has at most ``tolerance`` bytes more than the share, or
    once all keys between have been probed. Otherwise more keys between are probed.
    """
    n_rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goals = -(-np.arange(1, n_shards) * total // n_shards)
    share = min(1.0, max(PROBES_EACH * n_shards, 4 * total // part_bytes) / max(1, n_rows))
    probes = _probes(keys, None, share)
    while True:
        rows, below = _below(keys, probes)
        at = np.searchsorted(below[:-1], goals)
        unmet = sorted({int(a) for a, g in zip(at, goals, strict=True) if a == len(probes) or below[a] - g > tolerance})
        if share >= 1 or not unmet:
            return probes, rows, below, at
        spans = [(probes[a - 1] if a else b"", probes[a] if a < len(probes) else b"\xff" * WIDTH) for a in unmet]
        between = sum(int(rows[a] - (rows[a - 1] if a else 0)) for a in unmet)
        share, fresh_probes = min(1.0, PROBES_MOST / max(1, between)), probes[:0]
        while not len(fresh_probes := _probes(keys, spans, share)) and share < 1:
            share = min(1.0, 8 * share)  # many rows, but few keys
        probes = np.unique(np.concatenate([probes, fresh_probes]))


def shard(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, tolerance: int = 0,
) -> DataFrame:
    """``docs`` with shard, from 0 to ``n_shards`` - 1, and slot, the row's place in its shard, from 0.

    Rows are ordered by a hash of the text, so that equal texts are neighbours, then id, then more
    of the hash. A row is in shard s if the bytes of the rows before it are at least s and less than
    s + 1 of ``n_shards`` even parts; a row's size is its text's UTF-8 bytes plus ``ROW_BYTES``. A
    positive ``tolerance`` saves rounds and lets each splitter lie so many bytes later.

    The rows are exchanged once, in parts of about ``part_bytes`` that don't cross shards; what is
    before a part is known from the counts, so no task holds a shard. Null texts are empty and null
    ids come first. Rows of equal id and text stay in one part, in any order. No rows give no rows,
    and with fewer rows than shards some shards are empty. Other columns pass through, but those
    named shard or slot are replaced.
    """
    rest = without(docs, ADDED)
    names = {c: fresh(rest.columns, c) for c in (*KEY, "part", "offset")}
    text = F.coalesce(named(text_col), F.lit(""))
    parts_of_key = (digest_part(text, 1), named(id_col).cast("bigint"), digest_part(text, 16))
    bound_batches(docs.sparkSession)
    keys = store(docs.select(*[k.alias(n) for k, n in zip(parts_of_key, KEY, strict=True)], size_of(named(text_col)).alias("size")))
    probes, rows, below, begins = splitters(keys, n_shards, part_bytes, tolerance)
    cells = below[:-1] // part_bytes
    starts = np.unique(np.concatenate([begins[begins < len(probes)], np.flatnonzero(cells[1:] != cells[:-1]) + 1])).astype(np.int64)
    shards = np.concatenate([[0], np.searchsorted(begins, starts, side="right")])
    ahead = np.concatenate([[0], rows[starts]])
    shard_ahead = np.concatenate([[0], np.where(begins < len(probes), rows[np.minimum(begins, len(probes))], rows[-1])])
    offsets = ahead - shard_ahead[shards]
    bounds = docs.sparkSession.sparkContext.broadcast(probes[starts])

    @F.pandas_udf("int")
    def part_of(k1: pd.Series, ids: pd.Series, known: pd.Series, k2: pd.Series) -> pd.Series:
        own = packed(k1.to_numpy(np.int64), ids.to_numpy(np.int64), known.to_numpy(bool), k2.to_numpy(np.int64))
        return pd.Series(np.searchsorted(bounds.value, own, side="right").astype(np.int32))

    table = docs.sparkSession.createDataFrame(
        pd.DataFrame({names["part"]: np.arange(len(shards), dtype=np.int32), "shard": shards.astype(np.int32), names["offset"]: offsets.astype(np.int64)})
    )
    keyed = rest.select("*", *[k.alias(names[n]) for k, n in zip(parts_of_key, KEY, strict=True)])
    placed = keyed.withColumn(names["part"], part_of(
        F.col(names["k1"]), F.coalesce(F.col(names["id"]), F.lit(0)), F.col(names["id"]).isNotNull(), F.col(names["k2"])
    ))
    order = Window.partitionBy(names["part"]).orderBy(*[F.col(names[n]) for n in KEY])
    numbered = placed.withColumn("slot", (F.row_number().over(order) - 1).cast("bigint"))
    # As many rows as parts: fewer than four for each ``part_bytes`` of input, plus one a shard.
    out = numbered.join(F.broadcast(table), names["part"]).withColumn("slot", F.col("slot") + F.col(names["offset"]))
    return out.select(*[named(c) for c in rest.columns], "shard", "slot")
