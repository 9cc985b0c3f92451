"""Scans, incremental windows, table writes and exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from itemrec.catalog.registry import query, sql_view
from itemrec.plans import profiles
from itemrec.runtime import ensure_checkpoint_dir, store
from itemrec.sources import scans, sinks
from itemrec.sources.views import AS_OF

AVG_SQL = """select video_id, cast(pos as int) as pos, round(avg(v), 6) + 0.0 as value
    from (select video_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from item_vector) group by video_id, pos"""


def scratch(spark) -> str:
    """A fresh folder on the cluster's shared storage."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", uuid.uuid4().hex)


@query("scan_interactions", """
    select user_id, video_id, mean_percentage_watched from interaction
    where last_watched_timestamp >= timestamp '2000-01-01' and last_watched_timestamp <= timestamp '2000-06-30 23:59:59'
      and video_id in (select video_id from item_unique)
    order by last_watched_timestamp desc, user_id, video_id""")
def scan_interactions(t):
    rows = scans.scan_interactions(t.interaction, "2000-01-01", "2000-06-30", items=t.item_unique)
    return rows.select("user_id", "video_id", "mean_percentage_watched")


@query("scan_item_index", """
    select uri, post_id, canister_id, is_nsfw from item_index where canister_id in ('can-1', 'can-3', 'can-5') and is_nsfw = false""")
def scan_item_index(t):
    return scans.scan_item_index(
        t.item_index, ["uri", "post_id", "canister_id", "is_nsfw"], canisters=["can-1", "can-3", "can-5"], is_nsfw=False
    )


@query("scan_duplicates", """
    select original_video_id, parent_video_id, duplication_score, exact_duplicate from item_duplicates
    where duplication_score >= 0.3 order by duplication_score desc, original_video_id""")
def scan_duplicates(t):
    return scans.scan_duplicates(t.item_duplicates, min_score=0.3)


@query("incremental_windows", """
    select strftime(date '1995-01-01' + cast(floor(date_diff('day', date '1995-01-01', last_watched_timestamp::date) / 7) * 7 as int), '%Y-%m-%d') as window_start,
           count(*) as num_rows, count(distinct user_id) as users
    from interaction group by 1""")
def incremental_windows(t):
    """Two loads: the second finds the first load's windows written and adds only the pending ones."""
    path = scratch(t.spark)
    rows = scans.with_window_start(t.interaction.select("user_id", "video_id", "last_watched_timestamp"), "last_watched_timestamp", "1995-01-01")
    sinks.write_windows(rows.where("last_watched_timestamp < timestamp '2000-01-01'"), path)
    schema = "user_id string, video_id string, last_watched_timestamp timestamp, window_start date"
    written = t.spark.read.schema(schema).parquet(path)
    bounds = rows.agg(F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    newest = written.agg(F.max("window_start").alias("window_start"))  # it may be incomplete
    pending = scans.pending_windows(bounds, written).unionByName(newest)
    sinks.write_windows(rows.join(pending, "window_start", "left_semi").select(*rows.columns), path)
    stored = t.spark.read.schema(schema).parquet(path)
    return stored.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("window_start")).agg(
        F.count(F.lit(1)).alias("num_rows"), F.countDistinct("user_id").alias("users")
    )


@query("write_profile_tables", f"""
    select user_id, cluster_id, video_id, liked, '{AS_OF}' as updated_at from user_item_cluster""")
def write_profile_tables(t):
    """Writes both tables and reads the interaction table back."""
    pages = profiles.collect_engagement(t.user_item_cluster)
    users = t.user_cluster.withColumn("user_embedding", F.array(F.col("cluster_id").cast("double")))
    clustered = pages.withColumnRenamed("items", "engagement").join(users, "user_id")
    base = scratch(t.spark)
    sinks.write_profile_tables(clustered, AS_OF, base + "/embedding", base + "/interaction")
    stored = t.spark.read.parquet(base + "/interaction")
    stamp = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")
    return stored.select("user_id", "cluster_id", "video_id", "liked", stamp)


@query("overwrite_cluster_slice", """
    select content_type, cluster_id, count(*) as num_rows,
           count(*) filter (where cluster_id = 1) as second_load
    from (select content_type, cluster_id from split_interaction where content_type is not null
          and (cluster_id <> 1 or mean_percentage_watched > 0.5)) group by content_type, cluster_id""")
def overwrite_cluster_slice(t):
    """All slices are written, then cluster 1 is replaced by a later load."""
    from itemrec.catalog.products import split

    path = scratch(t.spark)
    rows = split(t).where("content_type is not null").select("content_type", "cluster_id", "user_id", "video_id", "mean_percentage_watched")
    sinks.overwrite_slices(rows.withColumn("load", F.lit(1)), path)
    later = rows.where("cluster_id = 1 and mean_percentage_watched > 0.5").withColumn("load", F.lit(2))
    sinks.overwrite_slices(later, path)
    return t.spark.read.parquet(path).groupBy("content_type", "cluster_id").agg(
        F.count(F.lit(1)).alias("num_rows"), F.count_if(F.col("load") == 2).alias("second_load")
    )


sql_view("kv_rows", """
    select content_type || ':' || cluster_id || ':' || bin || ':' || query_video_id || ':watch_time_quantile_bin_candidate' as key,
           candidate_video_id as value from tier_candidates
    union all
    select content_type || ':' || cluster_id || ':' || video_id_x || ':modified_iou_candidate', video_id_y from iou_candidates""")


@query("export_kv_lists", """
    select key, page, string_agg(value, ',' order by value) as items from (
        select key, value, cast((row_number() over (partition by key order by value) - 1) // 100 as int) as page
        from (select distinct key, value from kv_rows)) group by key, page""")
def export_kv_lists(t):
    from itemrec.catalog.products import iou_table as iou, tier_table as tier

    lists = sinks.kv_lists(sinks.kv_union(tier(t), iou(t)), page_size=100)
    return lists.select("key", "page", F.array_join("items", ",").alias("items"))


@query("export_kv_union", "select key, value from kv_rows")
def export_kv_union(t):
    from itemrec.catalog.products import iou_table as iou, tier_table as tier

    return sinks.kv_union(tier(t), iou(t))


sql_view("id_universe", """
    select query_video_id as video_id from tier_candidates union select candidate_video_id from tier_candidates
    union select video_id_x from iou_candidates union select video_id_y from iou_candidates""")


@query("export_id_universe", "select video_id from id_universe")
def export_id_universe(t):
    from itemrec.catalog.products import iou_table as iou, tier_table as tier

    return sinks.id_universe(tier(t), iou(t))


@query("export_embedding_batches", f"select * from ({AVG_SQL}) where video_id in (select video_id from id_universe)")
def export_embedding_batches(t):
    """Written in files of at most 200 vectors and read back."""
    from itemrec.catalog.products import iou_table as iou, tier_table as tier

    path = scratch(t.spark)
    universe = store(sinks.id_universe(tier(t), iou(t)))
    sinks.embedding_batches(universe, profiles.avg_embedding(t.item_index, universe), 200, path)
    long = t.spark.read.parquet(path).select("video_id", F.posexplode("avg_embedding").alias("pos", "value"))
    return long.withColumn("value", F.round("value", 6) + F.lit(0.0))
