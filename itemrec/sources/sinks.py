"""Table writes and key-value exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.functions import ids
from itemrec.operators.ranking import paged_lists


def profile_tables(clustered: DataFrame, updated_at: str) -> tuple[DataFrame, DataFrame]:
    """One clustered-user table (user_id, cluster_id, user_embedding, engagement) as two stamped tables."""
    stamp = F.lit(updated_at).cast("timestamp").alias("updated_at")
    embeddings = clustered.select("user_id", "cluster_id", "user_embedding", stamp)
    items = clustered.select("user_id", "cluster_id", F.explode("engagement").alias("e")).select("user_id", "cluster_id", "e.*", stamp)
    return embeddings, items


def write_profile_tables(clustered: DataFrame, updated_at: str, embedding_path: str, item_path: str) -> None:
    embeddings, items = profile_tables(clustered, updated_at)
    embeddings.write.mode("overwrite").parquet(embedding_path)
    items.write.mode("overwrite").partitionBy("cluster_id").parquet(item_path)


def overwrite_slices(df: DataFrame, path: str, keys: tuple[str, ...] = ("content_type", "cluster_id")) -> None:
    """Replace exactly the slices present in ``df`` and leave the others."""
    (
        df.repartition(*[F.col(k) for k in keys], F.pmod(F.hash(*df.columns), F.lit(64)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    )


def write_windows(df: DataFrame, path: str) -> None:
    """Dynamic partition overwrite by ``window_start``, so a rerun replaces only its own windows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(path)


def tier_kv_rows(tier: DataFrame) -> DataFrame:
    key = ids.cache_key(F.col("content_type"), F.col("cluster_id"), F.col("bin"), F.col("query_video_id"), F.lit("watch_time_quantile_bin_candidate"))
    return tier.select(key.alias("key"), F.col("candidate_video_id").alias("value"))


def iou_kv_rows(iou: DataFrame) -> DataFrame:
    key = ids.cache_key(F.col("content_type"), F.col("cluster_id"), F.col("video_id_x"), F.lit("modified_iou_candidate"))
    return iou.select(key.alias("key"), F.col("video_id_y").alias("value"))


def kv_union(tier: DataFrame, iou: DataFrame) -> DataFrame:
    return tier_kv_rows(tier).unionByName(iou_kv_rows(iou))


def kv_lists(rows: DataFrame, page_size: int = 1000) -> DataFrame:
    """key, page, items: distinct values in order, long lists over several pages."""
    return paged_lists(rows.distinct(), ["key"], [F.col("value")], F.col("value"), page_size)


def id_universe(tier: DataFrame, iou: DataFrame) -> DataFrame:
    """Every id that occurs as query or candidate of either kind."""
    a = tier.select(F.explode(F.array("query_video_id", "candidate_video_id")).alias("video_id"))
    b = iou.select(F.explode(F.array("video_id_x", "video_id_y")).alias("video_id"))
    return a.unionByName(b).distinct()


def embedding_batches(universe: DataFrame, averages: DataFrame, rows_per_file: int, path: str) -> None:
    """Vectors of the id universe in files of bounded length."""
    averages.join(universe, "video_id", "left_semi").write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(path)
