"""Sorting, top-k, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemrec import quality
from itemrec.catalog import products
from itemrec.catalog.registry import query, sql_view
from itemrec.functions import rules
from itemrec.operators import iou, pools, summaries, tiers
from itemrec.operators import split as split_ops
from itemrec.operators.ranking import ranked
from itemrec.plans import serve
from itemrec.runtime import materialize
from itemrec.sources.views import AS_OF


# every seventh time is unreadable and every eleventh missing
@query("watch_history_order", """
    select content_type, user_id, video_id, row_number() over (partition by content_type, user_id order by t desc, video_id) - 1 as pos from (
        select content_type, user_id, video_id, case when key % 7 = 0 or key % 11 = 0 then timestamp '1970-01-01' else last_watched_timestamp end as t
        from (select i.*, ('0x' || substr(video_id, 1, 4))::bigint as key from content_interaction i) where mean_percentage_watched >= 0.1)""")
def watch_history_order(t):
    key = F.conv(F.substring("video_id", 1, 4), 16, 10).cast("bigint")
    text = F.when(key % 7 == 0, "not a time").when(key % 11 != 0, F.date_format("last_watched_timestamp", "yyyy-MM-dd HH:mm:ss"))
    rows = products.labelled(t).withColumn("last_watched_timestamp", text)
    wanted = serve.filter_watch_range(rows).withColumn("t", serve.watch_time_of(F.col("last_watched_timestamp")))
    placed = ranked(wanted.select("content_type", "user_id", "video_id", "t"), ["content_type", "user_id"], [F.col("t").desc(), F.col("video_id")])
    return placed.select("content_type", "user_id", "video_id", (F.col("rn") - 1).alias("pos"))


@query("iou_top5pct", """
    select content_type, cluster_id, p95, pairs, kept from (
        select content_type, cluster_id, quantile_disc(iou_modified, 0.95) as p95, count(*) as pairs from scored_pair group by all)
    join (select content_type, cluster_id, count(*) as kept from iou_candidates group by all) using (content_type, cluster_id)""")
def iou_top5pct(t):
    """The cut itself and how many pairs it keeps."""
    scores = iou.PairScores(products.labelled(t))
    limits = materialize(scores.thresholds())
    keys = ["content_type", "cluster_id"]
    pairs = scores.histogram().groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
    kept = scores.above(limits).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    return limits.join(pairs, keys).join(kept, keys)


@query("region_topk", """
    select nsfw_label, region, video_id, score, cast(position as int) as position from (
        select *, row_number() over (partition by nsfw_label, region order by score desc, video_id desc) as position
        from region_candidate where nsfw_label is not null and score >= 20 and score <= 120) where position <= 50""")
def region_topk(t):
    rows = pools.region_topk(pools.region_candidates(t.region_popularity, t.item_nsfw), low=20, high=120)
    return rows.select("nsfw_label", "region", "video_id", "score", "position")


@query("region_stats", """
    select nsfw_label, region, count(*) as items, min(score) as min_score, max(score) as max_score from region_candidate where nsfw_label is not null group by all""")
def region_stats(t):
    return pools.region_stats(pools.region_candidates(t.region_popularity, t.item_nsfw))


@query("pool_shuffle_sample", """
    select content_type, video_id, cast(position as int) as position from (
        select content_type, video_id, row_number() over (partition by content_type order by md5('shuffle|' || video_id), video_id) as position from popular_item
        where content_type is not null) where position <= 100""")
def pool_shuffle_sample(t):
    items = pools.popular_items(t.item_index, t.item_nsfw, "items").select("content_type", "video_id")
    return pools.shuffle_sample(items, 100, "shuffle")


def _picked(seed: str, k: int, wrap: bool) -> str:
    starts = "n" if wrap else f"greatest(n - {k} + 1, 1)"
    return f"""
        with p as (select content_type, video_id, position, max(position) over (partition by content_type) as n from popular_pool),
        u as (select user_id, ('0x' || substr(md5('{seed}|' || user_id), 1, 7))::bigint as h from user_region)
        select user_id, content_type, video_id, case when n <= {k} then position else (position - 1 - h % {starts} + n) % n + 1 end as rank
        from p, u where n <= {k} or (position - 1 - h % {starts} + n) % n < {k}"""


@query("pool_sample_k", _picked("lot", 20, True))
def pool_sample_k(t):
    pool = materialize(pools.popular_pool(t.item_index, t.item_nsfw, "items"))
    users = t.user_region.select("user_id", F.explode(F.array(F.lit("clean"), F.lit("nsfw"))).alias("content_type"))
    return pools.pool_rotation(users, pool, 20, "lot").select("user_id", "content_type", "video_id", F.col("rank").cast("bigint").alias("rank"))


@query("pool_contiguous_sample", _picked("run", 15, False))
def pool_contiguous_sample(t):
    pool = materialize(pools.popular_pool(t.item_index, t.item_nsfw, "items"))
    users = t.user_region.select("user_id", F.explode(F.array(F.lit("clean"), F.lit("nsfw"))).alias("content_type"))
    rows = pools.pool_rotation(users, pool, 15, "run", wrap=False)
    return rows.select("user_id", "content_type", "video_id", F.col("rank").cast("bigint").alias("rank"))


sql_view("item_popularity", """
    select content_type, video_id, count(*) as score from split_interaction where content_type is not null group by all""")


@query("popular_percentile_pool", """
    select content_type, video_id, score from (select *, percent_rank() over (partition by content_type order by score desc) as r from item_popularity) where r <= 0.3""")
def popular_percentile_pool(t):
    scored = products.labelled(t).groupBy("content_type", "video_id").agg(F.count(F.lit(1)).alias("score"))
    return pools.popular_percentile_pool(scored).select("content_type", "video_id", "score")


@query("stratified_user_sample", """
    select content_type, cluster_id, bin, user_id from (select *, row_number() over (partition by content_type, cluster_id, bin
           order by md5('sample|' || user_id), user_id) as rn from tier_user where items_watched > 10) where rn <= 10""")
def stratified_user_sample(t):
    rows = summaries.stratified_user_sample(tiers.ntile_tiers(products.watch_time(t)), 10, 10)
    return rows.select("content_type", "cluster_id", "bin", "user_id")


@query("final_trim", "select user_id, video_id, cast(position as int) as place from newest_row where position <= 50")
def final_trim(t):
    return serve.final_trim(products.newest_rows(t)).select("user_id", "video_id", "place")


# ---- set operations --------------------------------------------------------------------------------

@query("tier_progression_diff", "select content_type, cluster_id, bin, video_id from tier_progression")
def tier_progression_diff(t):
    items = products.tier_item_rows(t)
    sizes = items.groupBy("content_type", "cluster_id", "bin").agg(F.count(F.lit(1)).alias("num_items"))
    return tiers.tier_progression(items, materialize(tiers.lag_tier(sizes)))


@query("user_list_intersect", """
    select content_type, cluster_id, num as shared_users, count(*) as pairs from scored_pair group by all""")
def user_list_intersect(t):
    """Sizes of shared finishing-user sets over all pairs that share any."""
    return iou.PairScores(products.labelled(t)).directed().groupBy(
        "content_type", "cluster_id", F.col("num").alias("shared_users")
    ).agg(F.count(F.lit(1)).alias("pairs"))


@query("history_set_diff", """
    select user_id, video_id, position from newest_row n
    where not exists (select 1 from watched_pair w where w.user_id = n.user_id and w.video_id = n.video_id) order by user_id, position""")
def history_set_diff(t):
    rows = serve.exclude_items(products.newest_rows(t), pools.watched_items(t.interaction, AS_OF))
    return rows.orderBy("user_id", "position")


@query("dedup_preserve_order", """
    select user_id, item_id as video_id, min(event_id) as position from watch_event group by all""")
def dedup_preserve_order(t):
    rows = t.watch_event.select("user_id", F.col("item_id").alias("video_id"), F.col("event_id").alias("position"))
    return serve.dedup_preserve_order(rows)


@query("pool_concat", """
    select content_type, region as pool_key, video_id, 0 as source, position as rank from region_pool
    union all select content_type, 'global', video_id, 1, position from popular_pool
    union all select content_type, 'global', video_id, 2, position from untouched_pool""")
def pool_concat(t):
    def build(content):
        regional = products.region_rows(t, content).select(F.col("region").alias("pool_key"), "video_id", F.col("position").alias("rank"))
        shared = (products.popular_rows(t, content), products.untouched_rows(t, content))
        return pools.pool_concat(regional, *[p.select(F.lit("global").alias("pool_key"), "video_id", F.col("position").alias("rank")) for p in shared], key="pool_key")

    return products.of_both(build)


@query("result_diff_check", """
    select side, count(*) as num_rows from interaction join item_nsfw using (video_id), (values ('left'), ('right')) s(side)
    where probability = 0.7 group by side""")
def result_diff_check(t):
    """Two labellings of the same rows that differ in one bound."""
    rows = split_ops.attach_probability(t.interaction, t.item_nsfw)
    left = rows.select("user_id", "video_id", rules.nsfw_split_label(F.col("probability")).alias("nsfw_label"))
    right = rows.select("user_id", "video_id", rules.nsfw_region_label(F.col("probability")).alias("nsfw_label"))
    return quality.difference(left, right).groupBy("side").agg(F.count(F.lit(1)).alias("num_rows"))
