"""Distributed positions against plain windows."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from itemrec.operators import ranking
from itemrec.operators.ranking import ntile_from, paged_lists, ranked, top_n, with_percent_rank
from itemrec.operators.pools import pool_rotation
from itemrec.operators.sessions import session_baskets, sessionize


def skewed(spark):
    """Group 0 holds a third of the rows; many ties."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 7).cast("int") + 1).alias("g"), (F.col("id") % 11).alias("v"), "id"
    ).repartition(6)


def test_positions_tiers_and_percent_rank(spark):
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"), (F.ntile(4).over(w) - 1).alias("t"),
                     F.percent_rank().over(Window.partitionBy("g").orderBy("v")).alias("p")).orderBy("id").toPandas()
    got = ranked(df, ["g"], [F.col("v"), F.col("id")]).withColumn("t", ntile_from(F.col("rn"), F.col("group_n"), 4))
    ranks = with_percent_rank(df, ["g"], "v", [F.col("id")], "p").select("id", "p")
    got = got.join(ranks, "id").select("id", "rn", "t", "p").orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_null_groups_and_short_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = {(r.g, r.v): (r.rn, r.group_n) for r in ranked(df, ["g"], [F.col("v")]).collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), ("a", 3): (1, 1)}
    one = with_percent_rank(df.where("g = 'a'"), ["g"], "v", [F.col("v")], "p").collect()
    assert one[0].p == 0.0


def test_ntile_fewer_rows_than_buckets(spark):
    rows = spark.range(3).select((F.col("id") + 1).alias("rn"), F.lit(3).alias("n"))
    assert [r[0] for r in rows.select(ntile_from(F.col("rn"), F.col("n"), 4)).collect()] == [0, 1, 2]


def test_pages_are_whole_ordered_and_bounded(spark):
    pages = paged_lists(skewed(spark), ["g"], [F.col("id")], F.col("id"), 100)
    rows = pages.orderBy("g", "page").collect()
    assert max(len(r["items"]) for r in rows) == 100
    first = [x for r in rows if r.g == 0 for x in r["items"]]
    assert first == list(range(0, 3000, 3))


def test_top_n_limits_before_the_shuffle(spark):
    plan = top_n(skewed(spark), ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_rotation_takes_distinct_places(spark):
    users = spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.lit("clean").alias("content_type"))
    pool = spark.range(1, 31).select(F.lit("clean").alias("content_type"), F.col("id").cast("int").alias("position"), F.col("id").cast("string").alias("video_id"))
    for k, wrap, size in ((8, True, 8), (8, False, 8), (40, True, 30)):
        rows = pool_rotation(users, pool, k, "s", wrap).groupBy("user_id").agg(F.countDistinct("video_id").alias("n"), F.max("rank").alias("top"))
        assert {(r.n, r.top) for r in rows.collect()} == {(size, size)}


def test_session_gaps(spark):
    stamps = [0.0, 599.0, 1199.0, 1799.5, 2400.5, 3001.5, 7202.0]
    rows = [("u", i, f"v{i}", s) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, "user_id string, event_id int, item_id string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("bigint")))
    got = [r.session_id for r in sessionize(df).orderBy("event_id").collect()]
    # gaps 599, 600, 600.5, 601, 601, then over an hour
    assert got == [0, 0, 0, 0, 1, 2, 3]
    busy = spark.range(12).select(F.lit("u").alias("user_id"), F.lit(0).alias("session_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("item_id"))
    assert [len(r["items"]) for r in session_baskets(busy).orderBy("batch_index").collect()] == [5, 5, 2]


def test_large_limits_are_ranked_by_a_distributed_sort(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i % 2}", i * 7 % 50) for i in range(50)] + [(None, 1)], "g string, v int")
    window = sorted(map(tuple, ranking.top_n(df, ["g"], [F.col("v")], 9).collect()), key=str)
    monkeypatch.setattr(ranking, "WINDOW_LIMIT", 5)
    large = ranking.top_n(df, ["g"], [F.col("v")], 9)
    assert sorted(map(tuple, large.collect()), key=str) == window and len(window) == 19
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
