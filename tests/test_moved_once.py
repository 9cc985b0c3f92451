"""Vectors of sampled places only, made by many tasks, and positions without moving all rows."""

import math

from pyspark.sql import functions as F

from itemrec.operators import tiers
from itemrec.operators.ranking import ranked
from itemrec.plans import profiles
from itemrec.sources.views import Tables


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_only_sampled_places_have_vectors_read(spark):
    flow = "content_type string, cluster_id int, bin int"
    queries = spark.createDataFrame([("clean", 0, 1, "f", "q", 3, 40)], f"{flow}, comparison_flow string, query_video_id string, start bigint, n bigint")
    targets = spark.createDataFrame([("clean", 0, 1, i + 1, f"t{i}") for i in range(40)], f"{flow}, rn bigint, candidate_video_id string")
    angle = {"q": 0.0} | {f"t{i}": i / 100 for i in range(40)}
    vectors = spark.createDataFrame([(v, [math.cos(a), math.sin(a)]) for v, a in angle.items()], "video_id string, avg_embedding array<double>")
    asked = []

    def averages(wanted):
        asked.extend(r[0] for r in wanted.collect())
        return vectors.join(wanted, "video_id")

    plan = tiers.SamplePlan(queries, targets, 4)
    got = {r.candidate_video_id: r.distance for r in tiers.tier_distances(plan, averages, None).collect()}
    assert got == {f"t{i}": round(1 - math.cos(i / 100), 9) for i in range(3, 7)}
    assert sorted(asked) == ["q", "t3", "t4", "t5", "t6"]
    assert got == {r.candidate_video_id: r.distance for r in tiers.tier_distances(plan, vectors, None, chunk=3).collect()}


def test_averages_of_wanted_items(spark):
    index = spark.createDataFrame([(f"gs://items/{v}.mp4", [x], None) for v, x in (("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0))],
                                  "uri string, embedding array<float>, item_timestamp timestamp")
    wanted = spark.createDataFrame([("a",), ("c",), (None,)], "video_id string")
    assert [tuple(r) for r in profiles.avg_embedding(index, wanted).collect()] == [("a", [2.0])]


def test_vectors_of_the_index_are_made_by_many_tasks(spark, tmp_path):
    spark.range(1, 200).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(4).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(0).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    index = Tables(spark, str(tmp_path)).item_index
    used = index.select("uri", F.spark_partition_id().alias("p"))
    assert index.count() == 2 * 199 and used.select("p").distinct().count() > 2


def test_positions_are_added_without_moving_rows_again(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = ranked(rows, ["g"], [F.col("id")])
        assert "BroadcastHashJoin" in plan_of(placed) and "SortMergeJoin" not in plan_of(placed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert placed.where(F.col("rn") != F.floor(F.col("id") / 3) + 1).count() == 0
