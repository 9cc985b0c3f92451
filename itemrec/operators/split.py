"""Deduplicated interactions labelled by content type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.functions import rules


def unique_items_only(interactions: DataFrame, unique: DataFrame) -> DataFrame:
    return interactions.join(unique.select("video_id"), "video_id", "left_semi")


def attach_probability(df: DataFrame, nsfw: DataFrame) -> DataFrame:
    return df.join(nsfw.select("video_id", "probability").distinct(), "video_id", "left")


def split_interactions(interactions: DataFrame, unique: DataFrame, nsfw: DataFrame) -> DataFrame:
    """Interactions with unique items, plus ``probability``, ``nsfw_label`` and ``content_type``."""
    labelled = attach_probability(unique_items_only(interactions, unique), nsfw)
    return (
        labelled.drop("cluster_label")
        .withColumn("nsfw_label", rules.nsfw_split_label(F.col("probability")))
        .withColumn("content_type", rules.content_type(F.col("nsfw_label")))
    )


def split_stats(split: DataFrame) -> DataFrame:
    """Counts of rows, and of different items, users and clusters.

    Each kind of id is counted by a grouping of its own, which ends in a few numbers: no row is multiplied by the number of counts.
    Rows come together by id before they are grouped, so a task holds its share of the ids and not all that its rows name.
    """
    label = F.col("nsfw_label")
    rows = ("total_rows", "nsfw_rows", "clean_rows", "unlabelled_rows", "liked_rows", "shared_rows")
    by_item = split.select("video_id", "nsfw_label", "liked", "shared").repartition("video_id").groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(label).alias("nsfw_rows"), F.count_if(~label).alias("clean_rows"),
        F.count_if(label.isNull()).alias("unlabelled_rows"), F.count_if("liked").alias("liked_rows"), F.count_if("shared").alias("shared_rows"),
    )
    known = F.col("video_id").isNotNull()
    items = by_item.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows], F.count("video_id").alias("unique_videos"),
        F.count_if(known & (F.col("nsfw_rows") > 0)).alias("nsfw_videos"), F.count_if(known & (F.col("clean_rows") > 0)).alias("clean_videos"),
    )
    pairs = split.select("user_id", "cluster_id").repartition("user_id").groupBy("user_id", "cluster_id").agg(F.lit(1).alias("one"))
    users = pairs.agg(F.countDistinct("user_id").alias("unique_users"), F.countDistinct("cluster_id").alias("unique_clusters"))
    return items.crossJoin(users).select(
        "total_rows", "unique_videos", "unique_users", "unique_clusters", "nsfw_rows", "clean_rows", "unlabelled_rows", "nsfw_videos", "clean_videos", "liked_rows", "shared_rows"
    )
