"""What is made of a pool's entries or lists is made once for the pool."""

from pyspark.sql import functions as F

from itemrec.plans import serve


def test_pool_marks_are_made_before_pools_meet_users(spark):
    pools = spark.createDataFrame([("global", 6, "b"), ("global", 6, "a"), ("cluster:1", 3, "c")], "pool_key string, type_num int, video_id string")
    keys = spark.createDataFrame([("u", "global"), ("u", "cluster:1"), ("v", "global")], "user_id string, pool_key string")
    queries = spark.createDataFrame([("u", 1, 0, "q")], "user_id string, cluster_id int, bin int, query_video_id string")
    tier = spark.createDataFrame([(1, 0, "q", "x")], "cluster_id int, bin int, query_video_id string, candidate_video_id string")
    iou = spark.createDataFrame([(1, "q", "y")], "cluster_id int, video_id_x string, video_id_y string")
    mark = F.md5(F.concat(F.coalesce("query_video_id", F.lit("")), F.lit(">"), F.col("candidate_video_id")))
    rows = serve.fetch_all_candidates(queries, keys, tier, iou, pools, mark=mark)
    assert {(r.user_id, r.query_video_id, r.type_num, r.candidate_video_id) for r in rows.collect()} == {
        ("u", "q", 1, "x"), ("u", "q", 2, "y"), ("u", None, 6, "a"), ("u", None, 6, "b"), ("u", None, 3, "c"), ("v", None, 6, "a"), ("v", None, 6, "b")}
    assert rows.where(~mark.eqNullSafe(F.col("mark"))).count() == 0
    lists = serve.expand_pool_to_queries(pools, keys, queries, digest=F.array_join("candidates", ","))
    assert {(r.user_id, r.query_video_id, r.type_num, tuple(r.candidates), r.digest) for r in lists.collect()} == {
        ("u", "q", 6, ("a", "b"), "a,b"), ("u", "q", 3, ("c",), "c")}
    assert "array_join" not in lists._jdf.queryExecution().toString()
