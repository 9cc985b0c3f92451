"""Grouped summaries of interactions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.functions import ids
from itemrec.operators.ranking import top_n


def user_watch_time_map(seconds: DataFrame) -> DataFrame:
    """user -> {cluster: seconds}; as many entries as clusters."""
    entries = F.array_sort(F.collect_list(F.struct("cluster_id", "total_seconds")))
    return seconds.groupBy("user_id").agg(F.map_from_entries(entries).alias("watch_time"))


def tier_flow_counts(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Compared items and resulting candidates per (cluster, tier)."""
    compared = pairs.where("flag_compare").select("content_type", "cluster_id", "bin", F.col("num_cx").alias("compared_items"))
    found = candidates.groupBy("content_type", "cluster_id", "bin").agg(F.count(F.lit(1)).alias("candidates"))
    return compared.join(found, ["content_type", "cluster_id", "bin"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def distance_profile(distances: DataFrame, limit: float = 0.336) -> DataFrame:
    d = F.col("distance")
    return distances.groupBy("content_type", "cluster_id", "bin", "query_video_id").agg(
        F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("avg_distance"),
        F.count_if(d < limit).alias("matches_below_threshold"), F.count(F.lit(1)).alias("total_candidates"),
    )


def embedding_coverage(queries: DataFrame, known: DataFrame, by_row: bool = False) -> DataFrame:
    """Distinct, found and missing query items per cluster. ``by_row`` counts found rows against distinct items."""
    marked = queries.join(known.select("video_id").distinct().withColumn("_known", F.lit(True)), "video_id", "left")
    hit = F.col("_known").isNotNull()
    count = (lambda c: F.count_if(c)) if by_row else (lambda c: F.countDistinct(F.when(c, F.col("video_id"))))
    out = marked.groupBy("content_type", "cluster_id").agg(
        F.countDistinct("video_id").alias("total_videos"), count(hit).alias("videos_with_embeddings"), count(~hit).alias("videos_without_embeddings")
    )
    share = F.floor(F.col("videos_with_embeddings") / F.col("total_videos") * 100 * 100 + F.lit(0.5)) / 100
    return out.withColumn("percent_with_embeddings", share)


def iou_cluster_summary(split: DataFrame, candidates: DataFrame) -> DataFrame:
    keys = ["content_type", "cluster_id"]
    base = split.where("content_type is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interactions"), F.countDistinct("video_id").alias("videos"), F.countDistinct("user_id").alias("users")
    )
    pairs = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    return base.join(pairs, keys, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def watch_range(count: Column) -> Column:
    """Right-closed ranges of items watched."""
    edges = [0, 10, 20, 30, 50, 100, 200]
    out = None
    for low, high in zip(edges, edges[1:]):
        hit = (count > low) & (count <= high)
        out = F.when(hit, f"{low}-{high}") if out is None else out.when(hit, f"{low}-{high}")
    return out


def watch_count_ranges(interactions: DataFrame) -> DataFrame:
    """One row per user with its range; lists per range would not be bounded."""
    counts = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"))
    return counts.withColumn("watch_range", watch_range(F.col("items"))).where("watch_range is not null")


def candidate_overlap(tier: DataFrame, iou: DataFrame) -> DataFrame:
    a = tier.select("content_type", F.col("candidate_video_id").alias("video_id"))
    b = iou.select("content_type", F.col("video_id_y").alias("video_id"))
    return a.unionByName(b).groupBy("content_type").agg(
        F.count(F.lit(1)).alias("total_candidates"), F.countDistinct("video_id").alias("distinct_candidates")
    )


def user_profiles(interactions: DataFrame, metadata: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` items per user as a list of structs, with cluster and tier."""
    rows = top_n(interactions, ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")], n)
    lists = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "video_id", "last_watched_timestamp", "mean_percentage_watched"))).alias("_h")
    )
    drop_place = F.transform("_h", lambda s: s.dropFields("rn"))
    return lists.select("user_id", drop_place.alias("watch_history")).join(
        metadata.select("user_id", "cluster_id", F.col("bin").alias("watch_time_quantile_bin_id")), "user_id"
    )


def stratified_user_sample(tiers: DataFrame, n: int, min_items: int, seed: str = "sample") -> DataFrame:
    """``n`` random users per (content type, cluster, tier) among those with more than ``min_items`` items."""
    order = [ids.hash_order(seed, F.col("user_id")), F.col("user_id")]
    return top_n(tiers.where(F.col("items_watched") > min_items), ["content_type", "cluster_id", "bin"], order, n)
