import hashlib

import numpy as np
import pytest

from itemrec.llm import sharding

SMALL = "/root/testdata/sf0.001/documents.parquet"


def expected(rows, n_shards):
    """Shard of each row, in order of key, by the bytes before it."""
    def key(row):
        digest = hashlib.md5((row[1] or "").encode()).hexdigest()
        return int(digest[:15], 16), row[0] is not None, row[0] or 0, int(digest[15:30], 16)

    size = [len((t or "").encode()) + 16 for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))
    total, before, out, slots = sum(size), 0, [], {}
    for i in order:
        shard = before * n_shards // total
        slot = slots[shard] = slots.get(shard, -1) + 1
        out.append((rows[i][0], rows[i][1], shard, slot))
        before += size[i]
    return sorted(out, key=str)


def check(spark, rows, n_shards, **options):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, k1 string, Slot int")
    found = sharding.shard(df, n_shards, **options)
    assert found.columns == ["doc_id", "text", "k1", "shard", "slot"]
    assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in found.collect()), key=str) == expected(rows, n_shards)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).collect()], 40)


def test_parts_within_shards(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).collect()], 3, part_bytes=5_000)


def test_a_third_of_equal_texts_is_split(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(900)]
    check(spark, rows, 10)
    sizes = np.bincount([x[2] for x in expected(rows, 10)])
    assert sizes.max() <= 1.3 * sizes.min()


def test_refined_probes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PROBES_EACH", 2)
    monkeypatch.setattr(sharding, "PROBES_MOST", 40)
    check(spark, [(i, f"text {i} " * (i % 17)) for i in range(3000)], 7)


def test_tolerance_bounds_the_error(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PROBES_EACH", 4)
    rows = [(i, "x" * (i % 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = np.zeros(5)
    for r in sharding.shard(df, 5, tolerance=2_000).collect():
        sizes[r.shard] += len(r.text) + 16
    assert abs(sizes - sizes.mean()).max() <= 2_000 + 116


@pytest.mark.parametrize("rows", [[(1, "a")], [(None, None), (None, "a"), (None, None), (2, ""), (2, ""), (-5, "ß" * 5000)]])
def test_odd_rows(spark, rows):
    check(spark, rows, 4)


def test_no_rows(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id bigint, text string"), 4).collect() == []
