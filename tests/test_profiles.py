"""User vectors by their definition, and what moves for them."""

import math
import re

import pytest
from pyspark.sql import functions as F

from itemrec.plans import profiles

ROWS = "user_id string, video_id string, mean_percentage_watched double, last_watched_timestamp timestamp"


def history(spark):
    """u0 to u19 with up to 120 items, some unknown or hardly watched; a user with one item and rows without a user."""
    rows = [(f"u{u}", f"v{(u * 7 + i * 3) % 150}", (i % 5) / 5, i) for u in range(20) for i in range(u * 6 + 2)]
    rows += [("one", "v1", 1.0, 1), (None, "v1", 1.0, 1), (None, "v2", 1.0, 2), ("few", "v1", 0.1, 1), ("few", "lost", 1.0, 2), ("two", "v9", 0.9, 1), ("two", "v10", 0.0, 1)]
    frame = spark.createDataFrame(rows, "user_id string, video_id string, mean_percentage_watched double, s int")
    vectors = {f"v{i}": [math.sin(i), math.cos(i * 2), float(i % 3)] for i in range(140)}
    items = spark.createDataFrame([*vectors.items(), ("v139x", None), (None, [1.0, 2.0, 3.0])], "video_id string, embedding array<float>")
    return frame.withColumn("last_watched_timestamp", F.timestamp_seconds("s")).drop("s"), items, rows, vectors


def expected(rows, vectors, weight):
    out = {}
    for user in {r[0] for r in rows} - {None}:
        known = sorted((r for r in rows if r[0] == user and r[1] in vectors), key=lambda r: (-r[3], r[1]))
        kept = [r for r in known[:100] if r[2] * 100 > 25]
        if len(known) >= 2 and kept:
            total = [sum(weight(r, at) * vectors[r[1]][i] for at, r in enumerate(kept)) for i in range(3)]
            size = math.sqrt(sum(x * x for x in total))
            out[user] = [x / size for x in total]
    return out


WAYS = {
    "user_avg_embedding": lambda r, at: 1.0,
    "user_avg_embedding_watch_weighted": lambda r, at: r[2],
    "user_avg_embedding_decay": lambda r, at: math.sqrt(math.exp(-at / 10) * r[2] * 100),
}


@pytest.mark.parametrize("name", WAYS)
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_user_vectors_by_definition(spark, monkeypatch, name, held):
    monkeypatch.setattr(profiles, "HELD_BYTES", held)  # 1: sums are put out with every batch
    interactions, items, rows, vectors = history(spark)
    found = {r.user_id: list(r.embedding) for r in getattr(profiles, name)(interactions, items).collect()}
    wanted = expected(rows, vectors, WAYS[name])
    assert found.keys() == wanted.keys() and len(found) == 20
    assert all(found[u] == pytest.approx(wanted[u], abs=1e-6) for u in wanted)


def test_each_vector_of_an_item_counts(spark):
    interactions = spark.createDataFrame([("u", "a", 1.0, 1), ("u", "b", 1.0, 2)], "user_id string, video_id string, mean_percentage_watched double, s int")
    items = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 3.0])], "video_id string, embedding array<double>")
    rows = profiles.user_avg_embedding(interactions.withColumn("last_watched_timestamp", F.timestamp_seconds("s")), items).collect()
    assert [list(r.embedding) for r in rows] == [pytest.approx([0.6, 0.8])]


def test_no_vectors_at_all(spark):
    interactions, items, _, _ = history(spark)
    assert profiles.user_avg_embedding(interactions, items.where("false")).collect() == []


def test_rows_of_users_move_without_vectors(spark):
    """Vectors reach the sums once for each block of users: no join puts them beside rows, and no vector is added up in an aggregate's buffer."""
    interactions, items, _, _ = history(spark)
    text = profiles.user_avg_embedding(interactions, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and not re.search(r"aggregate_metrics|summar", text, re.I)
    assert all("embedding" not in line for line in text.splitlines() if re.search(r"\bJoin\b", line))
