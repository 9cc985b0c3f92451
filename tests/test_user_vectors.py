"""What moves for vectors of users, and rows that several steps read."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemrec.functions import ids
from itemrec.plans import profiles
from itemrec.sources.views import WATCHED, Tables


def moves(df):
    """The exchanges of a plan that has not run."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def test_packed_keys_stay_different(column):
    keys = ["ab", "AB", "abc", "0a", "a", "", "zz", "ab\n", "00", None, "é", "d41d8cd98f00b204e9800998ecf8427e"]
    found = column(ids.packed, keys, "string")
    assert found[9] is None and len({bytes(x) for x in found if x is not None}) == len(keys) - 1
    assert len(found[-1]) == 17 and bytes(found[2]) == b"\0abc"


def test_vectors_of_items_move_once(spark):
    index = spark.createDataFrame([("gs://b/a.mp4", [1.0, 2.0], 2), ("gs://b/a.mp4", [3.0, 4.0], 1), ("gs://c/a.mp4", [5.0, 6.0], 3), (None, [1.0, 1.0], 0), ("gs://b/x.mp4", None, 0)],
                                  "uri string, embedding array<float>, s int").withColumn("item_timestamp", F.timestamp_seconds("s"))
    first = profiles.first_embedding(index)
    assert len(moves(first)) == 1
    assert sorted(tuple(r) for r in first.collect()) == [("gs://b/a.mp4", "a", [3.0, 4.0]), ("gs://c/a.mp4", "a", [5.0, 6.0])]
    numbered = profiles.numbered_vectors(first)
    assert sorted(r.nth for r in numbered.collect()) == [1, 2]


def test_rows_of_users_with_few_are_not_joined_with_items(spark):
    """Rows go to their cell at once: the join that counts vectors has rows of users with more than the newest only."""
    rows = [(f"u{u}", f"v{i}", 1.0, i) for u in range(30) for i in range(20)] + [("lot", f"v{i}", 1.0, i) for i in range(130)]
    interactions = spark.createDataFrame(rows, "user_id string, video_id string, mean_percentage_watched double, s int").withColumn("last_watched_timestamp", F.timestamp_seconds("s"))
    items = spark.createDataFrame([(f"v{i}", [math.sin(i), math.cos(i)]) for i in range(125)], "video_id string, embedding array<double>")
    seen = {}
    plain = profiles._recent_watched
    profiles._recent_watched = lambda df, known: plain(seen.setdefault("rows", df), known)
    try:
        found = {r.user_id: list(r.embedding) for r in profiles.user_avg_embedding(interactions, items).collect()}
    finally:
        profiles._recent_watched = plain
    assert {r[0] for r in seen["rows"].select("user_id").collect()} == {"lot"}
    for user, kept in (("u7", range(20)), ("lot", range(25, 125))):
        total = [sum(math.sin(i) for i in kept), sum(math.cos(i) for i in kept)]
        assert found[user] == pytest.approx([x / math.hypot(*total) for x in total], abs=1e-9)


def test_blocks_of_users_hold_their_sums(spark):
    """As many blocks as keep a block's sums in a task: sums that don't fit are put out in parts, all of which move."""
    known = spark.createDataFrame([("v", [0.0] * 64)], "video_id string, embedding array<float>")
    assert profiles._blocks(5_400_000, known, 12)[0] >= 6
    by_user, by_item = profiles._blocks(1000, known, 12)
    assert by_user * by_item >= 12


def batch(rows):
    kinds = [("key", pa.binary()), ("nth", pa.int32()), ("user_id", pa.string()), ("weight", pa.float64()), ("embedding", pa.list_(pa.float32()))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


@pytest.mark.parametrize("cut", range(1, 9))
def test_items_that_lie_across_batches(cut):
    rows = [
        (b"a", None, "u", 1.0, None),  # an item without vectors
        (b"b", 1, None, None, [1.0, 0.0]), (b"b", 2, None, None, [0.0, 2.0]), (b"b", None, "u", 2.0, None), (b"b", None, "w", None, None),
        (b"b", 2, "x", 1.0, None), (b"c", None, "u", 5.0, None), (b"d", 1, None, None, [7.0, 7.0]), (b"d", None, "u", 1.0, None),
    ]
    found = {}
    for out in profiles._vector_sums(iter([batch(rows[:cut]), batch(rows[cut:])]), 1 << 20):
        for r in out.to_pylist():
            found[r["user_id"]] = (r["counted"], r["part"])
    assert found == {"u": (2, [9.0, 11.0]), "w": (1, None), "x": (profiles.MIN_ITEMS, [0.0, 2.0])}


def test_watched_rows_are_those_of_the_views(spark, tables):
    for name, more in (("interaction", []), ("user_item_cluster", ["cluster_label"])):
        columns = ["user_id", "video_id", *more, *WATCHED]
        kept, plain = tables.watched(name, *columns), getattr(tables, name).select(*columns)
        assert kept.schema.simpleString() == plain.schema.simpleString()
        assert kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()
    with pytest.raises(ValueError, match="liked"):
        Tables(spark, tables.folder).watched("interaction", "user_id", "liked")
