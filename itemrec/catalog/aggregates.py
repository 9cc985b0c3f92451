"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemrec import quality
from itemrec.catalog import products
from itemrec.catalog.functions import elements
from itemrec.catalog.registry import query, sql_view
from itemrec.catalog.scans import AVG_SQL
from itemrec.operators import clustering, iou, pools, summaries, tiers
from itemrec.operators import split as split_ops
from itemrec.plans import profiles
from itemrec.runtime import materialize, store
from itemrec.sources.views import AS_OF


@query("avg_embedding", AVG_SQL)
def avg_embedding(t):
    return elements(profiles.avg_embedding(t.item_index), "video_id", "avg_embedding")


@query("avg_embedding_incremental", f"select * from ({AVG_SQL})")
def avg_embedding_incremental(t):
    """A first load holds part of the ids; the second adds exactly the missing ones."""
    stored = materialize(profiles.avg_embedding(t.item_index.where("uri < 'gs://items/8'")))
    return elements(stored.unionByName(profiles.avg_embedding_incremental(t.item_index, stored)), "video_id", "avg_embedding")


@query("first_embedding", "select video_id, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, round(unnest(embedding::double[]), 6) + 0.0 as value from first_vector")
def first_embedding(t):
    first = profiles.first_embedding(t.item_index)
    return elements(first.withColumn("embedding", F.col("embedding").cast("array<double>")), "video_id", "embedding")


sql_view("recent_watched", """
    select user_id, video_id, mean_percentage_watched, last_watched_timestamp, embedding from (
        select *, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as recency,
               count(*) over (partition by user_id) as n
        from interaction join first_vector using (video_id))
    where n >= 2 and recency <= 100 and coalesce(mean_percentage_watched, 0) * 100 > 25""")


def _user_mean(weight: str, source: str = "recent_watched") -> str:
    return f"""
        select user_id, cast(pos as int) as pos, m / sqrt(sum(m * m) over (partition by user_id)) as r from (
            select user_id, pos, avg(v * w) as m from (
                select user_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding::double[]) as v, {weight} as w from {source})
            group by user_id, pos)"""


sql_view("user_average", _user_mean("1.0::double"))


@query("user_avg_embedding", "select user_id, pos, round(r, 6) + 0.0 as value from user_average")
def user_avg_embedding(t):
    return elements(profiles.user_avg_embedding(products.watches(t), profiles.first_embedding(t.item_index)), "user_id", "embedding")


@query("user_avg_embedding_watch_weighted", f"select user_id, pos, round(r, 6) + 0.0 as value from ({_user_mean('mean_percentage_watched')})")
def user_avg_embedding_watch_weighted(t):
    return elements(profiles.user_avg_embedding_watch_weighted(products.watches(t), profiles.first_embedding(t.item_index)), "user_id", "embedding")


sql_view("decayed", """
    select *, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) - 1 as place from recent_watched""")


@query("user_avg_embedding_decay", f"""
    select user_id, pos, round(r, 6) + 0.0 as value from ({_user_mean('sqrt(exp(-place / 10.0::double) * least(mean_percentage_watched * 100, 100))', 'decayed')})""")
def user_avg_embedding_decay(t):
    return elements(profiles.user_avg_embedding_decay(products.watches(t), profiles.first_embedding(t.item_index)), "user_id", "embedding")


@query("collect_engagement", """
    select user_id, page, string_agg(video_id, ',' order by rn) as items, count(*) filter (where liked) as liked from (
        select *, row_number() over (partition by user_id order by last_watched_timestamp, video_id) as rn,
               cast((row_number() over (partition by user_id order by last_watched_timestamp, video_id) - 1) // 25 as int) as page
        from user_item_cluster) group by user_id, page""")
def collect_engagement(t):
    lists = profiles.collect_engagement(t.user_item_cluster, page_size=25)
    liked = F.size(F.filter("items", lambda s: s["liked"])).cast("bigint")
    return lists.select("user_id", "page", F.array_join("items.video_id", ",").alias("items"), liked.alias("liked"))


sql_view("cluster_count", "select user_id, cluster_label, count(*) as n from user_item_cluster where cluster_label is not null group by all")
sql_view("cluster_share", """
    select user_id, c as pos, coalesce(n, 0) / sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by user_id)) as r,
           coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by user_id) as share
    from (select user_id, c from (select distinct user_id from cluster_count), range(10) x(c)) g
    left join (select user_id as u, cluster_label as l, n from cluster_count) on u = user_id and l = c""")


@query("cluster_distribution", "select user_id, cast(pos as int) as pos, round(r, 6) + 0.0 as value from cluster_share")
def cluster_distribution(t):
    return elements(profiles.cluster_distribution(t.user_item_cluster), "user_id", "distribution")


@query("cluster_distribution_share", "select user_id, cast(pos as int) as pos, round(share, 6) + 0.0 as value from cluster_share")
def cluster_distribution_share(t):
    return elements(profiles.cluster_distribution_share(t.user_item_cluster), "user_id", "distribution")


@query("temporal_distribution", """
    select user_id, cluster_label, time_bin, n from temporal_counts""")
def temporal_distribution(t):
    maps = profiles.temporal_distribution(t.user_item_cluster)
    rows = maps.select("user_id", F.explode("temporal").alias("cluster_label", "v")).select(
        "user_id", "cluster_label", F.posexplode("v").alias("time_bin", "n")
    )
    return rows.where("n > 0")


@query("timestamp_bounds", """
    select strftime(min(last_watched_timestamp), '%Y-%m-%d %H:%M:%S') as min_timestamp, strftime(max(last_watched_timestamp), '%Y-%m-%d %H:%M:%S') as max_timestamp
    from interaction""")
def timestamp_bounds(t):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return profiles.timestamp_bounds(t.interaction).select(stamp("min_timestamp"), stamp("max_timestamp"))


def _item_users(threshold: float) -> str:
    return f"""
        select content_type, cluster_id, video_id, count(*) as watches, count(distinct user_id) as users from split_interaction
        where content_type is not null and mean_percentage_watched > {threshold} group by all having count(distinct user_id) >= 2"""


@query("item_users_min", _item_users(0.5))
def item_users_min(t):
    rows = iou.item_audiences(products.split(t)).where("users_min >= 2")
    return rows.select("content_type", "cluster_id", "video_id", F.col("n_min").alias("watches"), F.col("users_min").alias("users"))


@query("item_users_success", _item_users(0.75))
def item_users_success(t):
    rows = iou.item_audiences(products.split(t)).where("users_success >= 2")
    return rows.select("content_type", "cluster_id", "video_id", F.col("n_success").alias("watches"), F.col("users_success").alias("users"))


@query("user_watch_time", "select content_type, cluster_id, user_id, total_seconds, items_watched from tier_seconds")
def user_watch_time(t):
    return products.watch_time(t)


@query("user_watch_time_map", """
    select user_id, count(*) as clusters, string_agg(cluster_id || '=' || cast(cast(round(total_seconds * 1000) as bigint) as varchar), ',' order by cluster_id) as watch_time
    from watch_seconds group by user_id""")
def user_watch_time_map(t):
    maps = summaries.user_watch_time_map(tiers.user_watch_time(t.user_item_cluster, ["cluster_id"]))
    entry = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000).cast("bigint"))
    return maps.select(
        "user_id", F.size("watch_time").cast("bigint").alias("clusters"),
        F.array_join(F.transform(F.map_entries("watch_time"), entry), ",").alias("watch_time"),
    )


@query("tier_bins", "select content_type, cluster_id, percentile_25, percentile_50, percentile_75, percentile_100, user_count from tier_bound")
def tier_bins(t):
    return tiers.tier_bins(products.watch_time(t))


# sketches keep ranks to well within two hundredths: what SQL says is the exact bins, and that the others are that close
@query("tier_bins_sketched", """
    select content_type, cluster_id, percentile_25, percentile_50, percentile_75, percentile_100, user_count, true as within_bound from tier_bound""")
def tier_bins_sketched(t):
    """Bins from one stored sketch per day and cluster, merged over the days, beside the exact ones."""
    seconds = materialize(products.watch_time(t))
    last = products.labelled(t).groupBy("content_type", "cluster_id", "user_id").agg(F.to_date(F.max("last_watched_timestamp")).alias("day"))
    sketches = store(tiers.watch_time_sketches(seconds.join(last, ["content_type", "cluster_id", "user_id"])))
    near = tiers.tier_bins_from(sketches)
    exact = tiers.tier_bins(seconds)
    return tiers.within_rank_bound(seconds, exact, near, 0.02)


@query("tier_item_lists", "select content_type, cluster_id, bin, video_id from tier_item")
def tier_item_lists(t):
    return products.tier_item_rows(t)


@query("split_stats", """
    select count(*) as total_rows, count(distinct video_id) as unique_videos, count(distinct user_id) as unique_users, count(distinct cluster_id) as unique_clusters,
           count(*) filter (where nsfw_label) as nsfw_rows, count(*) filter (where not nsfw_label) as clean_rows, count(*) filter (where nsfw_label is null) as unlabelled_rows,
           count(distinct video_id) filter (where nsfw_label) as nsfw_videos, count(distinct video_id) filter (where not nsfw_label) as clean_videos,
           count(*) filter (where liked) as liked_rows, count(*) filter (where shared) as shared_rows
    from split_interaction""")
def split_stats(t):
    return split_ops.split_stats(products.split(t))


@query("region_label_counts", """
    select region, count(*) filter (where nsfw_label) as nsfw_count, count(*) filter (where not nsfw_label) as clean_count,
           count(*) filter (where nsfw_label is null) as undetermined_count, count(*) as total_count from region_candidate group by region""")
def region_label_counts(t):
    return pools.region_label_counts(t.region_popularity, t.item_nsfw)


@query("region_examples", """
    with c as (select region, count(video_id) as num_items, count(*) filter (where nsfw_label is null) as num_null_label,
                      count(*) filter (where nsfw_label is not null) as num_nonnull_label, count(*) filter (where nsfw_label) as num_matching_label from region_candidate group by region
               order by num_items desc, region limit 20),
    e as (select region, string_agg(video_id, ',' order by rn) as examples from (
            select region, video_id, row_number() over (partition by region order by probability desc nulls last, video_id) as rn from region_candidate) where rn <= 5 group by region)
    select region, num_items, num_null_label, num_nonnull_label, num_matching_label, examples from c join e using (region)""")
def region_examples(t):
    rows = pools.region_examples(t.region_popularity, t.item_nsfw, wanted=True)
    return rows.select("region", "num_items", "num_null_label", "num_nonnull_label", "num_matching_label", F.array_join("example_videos.video_id", ",").alias("examples"))


@query("tier_flow_counts", """
    select p.content_type, p.cluster_id, p.bin, num_cx as compared_items, count(candidate_video_id) as candidates
    from tier_pair p left join tier_candidates c on c.content_type = p.content_type and c.cluster_id = p.cluster_id and c.bin = p.bin
    where flag_compare group by all""")
def tier_flow_counts(t):
    return summaries.tier_flow_counts(products.tier_pair_rows(t), products.tier(t))


@query("distance_profile", """
    select content_type, cluster_id, bin, query_video_id, round(min(distance), 6) as min_distance, round(max(distance), 6) as max_distance,
           round(avg(distance), 6) as avg_distance, count(*) filter (where distance < 0.336) as matches_below_threshold, count(*) as total_candidates
    from tier_far group by all""")
def distance_profile(t):
    rows = tiers.tier_distances(products.tier_plan(t), products.averages(t), None)
    out = summaries.distance_profile(rows)
    for c in ("min_distance", "max_distance", "avg_distance"):
        out = out.withColumn(c, F.round(c, 6))
    return out


sql_view("tier_query_row", """
    select s.content_type, s.cluster_id, s.bin, i.video_id from tier_source s
    join tier_item i on i.content_type = s.content_type and i.cluster_id = s.cluster_id and i.bin = s.prev_bin""")


@query("embedding_coverage", """
    select content_type, cluster_id, count(distinct video_id) as total_videos, count(distinct video_id) filter (where known) as videos_with_embeddings,
           count(distinct video_id) filter (where known is null) as videos_without_embeddings,
           floor(count(distinct video_id) filter (where known) / count(distinct video_id) * 100 * 100 + 0.5) / 100 as percent_with_embeddings
    from tier_query_row left join (select distinct video_id, true as known from item_vector) using (video_id) group by all""")
def embedding_coverage(t):
    items = products.tier_item_rows(t)
    flows = products.tier_pair_rows(t).where("flag_compare").select("content_type", "cluster_id", "bin", "prev_bin")
    queries = items.withColumnRenamed("bin", "prev_bin").join(flows, ["content_type", "cluster_id", "prev_bin"])
    return summaries.embedding_coverage(queries, profiles.keyed_vectors(t.item_index))


@query("iou_cluster_summary", """
    select content_type, cluster_id, interactions, videos, users, coalesce(candidates, 0) as candidates from (
        select content_type, cluster_id, count(*) as interactions, count(distinct video_id) as videos, count(distinct user_id) as users
        from split_interaction where content_type is not null group by all)
    left join (select content_type, cluster_id, count(*) as candidates from iou_candidates group by all) using (content_type, cluster_id)""")
def iou_cluster_summary(t):
    return summaries.iou_cluster_summary(products.split(t), products.iou(t))


@query("cluster_sizes", "select cluster_id, count(*) as members from user_cluster group by cluster_id")
def cluster_sizes(t):
    return clustering.cluster_sizes(t.user_cluster, "cluster_id")


@query("cluster_item_catalogue", "select distinct cluster_id, video_id from user_item_cluster")
def cluster_item_catalogue(t):
    return t.user_item_cluster.select("cluster_id", "video_id").distinct()


@query("watch_count_ranges", """
    select user_id, n as items, case when n <= 10 then '0-10' when n <= 20 then '10-20' when n <= 30 then '20-30' when n <= 50 then '30-50'
           when n <= 100 then '50-100' when n <= 200 then '100-200' end as watch_range
    from (select user_id, count(*) as n from interaction group by user_id) where n <= 200""")
def watch_count_ranges(t):
    return summaries.watch_count_ranges(t.interaction)


@query("cluster_fallback_pool", "select content_type, cluster_id, kind, video_id from cluster_pool")
def cluster_fallback_pool(t):
    return pools.cluster_fallback_pool(products.tier(t), products.iou(t))


@query("reported_items", "select user_id, video_id from (select *, row_number() over (partition by user_id order by video_id) as rn from reported_pair) where rn <= 2")
def reported_items(t):
    return pools.reported_items(t.reports, 2)


@query("user_history", "select user_id, video_id from (select *, row_number() over (partition by user_id order by video_id) as rn from watched_pair) where rn <= 2")
def user_history(t):
    return pools.user_history(t.interaction, AS_OF, size=2)


@query("region_scores", "select region, video_id, max(score) as score from region_candidate where nsfw_label is not null group by all")
def region_scores(t):
    """Rows keyed (region, item) rather than one map per region, which would not be bounded."""
    rows = pools.region_candidates(t.region_popularity, t.item_nsfw)
    return rows.groupBy("region", "video_id").agg(F.max("score").alias("score"))


@query("build_user_profiles", """
    select content_type, user_id, m.cluster_id, m.bin as watch_time_quantile_bin_id, count(*) as items, string_agg(video_id, ',' order by rn) as history
    from (select user_id, video_id, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as rn from interaction)
    join user_meta m using (user_id) where rn <= 100 group by all""")
def build_user_profiles(t):
    rows = products.of_both(lambda c: summaries.user_profiles(t.interaction, products.profile_of(t, c)))
    history = F.array_join("watch_history.video_id", ",").alias("history")
    return rows.select("content_type", "user_id", "cluster_id", "watch_time_quantile_bin_id", F.size("watch_history").cast("bigint").alias("items"), history)


@query("candidate_overlap", """
    select content_type, count(*) as total_candidates, count(distinct video_id) as distinct_candidates from (
        select content_type, candidate_video_id as video_id from tier_candidates union all select content_type, video_id_y from iou_candidates) group by content_type""")
def candidate_overlap(t):
    return summaries.candidate_overlap(products.tier(t), products.iou(t))


# ---- quality -------------------------------------------------------------------------------------

@query("expect_non_empty", """
    select 'split' as stage, count(*) as num_rows, count(*) > 0 as non_empty from split_interaction
    union all select 'tier_bins', count(*), count(*) > 0 from tier_bound
    union all select 'tier_pairs', count(*), count(*) > 0 from tier_pair""")
def expect_non_empty(t):
    rows = products.split(t)
    parts = {"split": rows, "tier_bins": tiers.tier_bins(products.watch_time(t)), "tier_pairs": products.tier_pair_rows(t)}
    return quality.row_report(parts)


@query("expect_keys_in_source", "select user_id, video_id, 'right' as side from watched_pair where user_id < 'u2'")
def expect_keys_in_source(t):
    """A stored history that lost part of its users is told apart from its source."""
    source = pools.watched_items(t.interaction, AS_OF)
    return quality.expect_keys_in_source(source.where("user_id >= 'u2'"), source, ["user_id", "video_id"])


@query("vector_shape_profile", """
    with parts as (
        select 'embedding' as vector_column, user_id, count(*) as length from user_average group by user_id
        union all select 'temporal', user_id, count(*) from temporal_mean group by user_id
        union all select 'distribution', user_id, count(*) from cluster_share group by user_id),
    whole as (select user_id from parts group by user_id having count(*) = 3)
    select vector_column, count(*) as num_rows, count(*) filter (where length is null) as missing, cast(min(length) as int) as min_length, cast(max(length) as int) as max_length
    from parts where user_id in (select user_id from whole) group by vector_column""")
def vector_shape_profile(t):
    joined = profiles.join_three_vectors(
        profiles.user_avg_embedding(products.watches(t), profiles.first_embedding(t.item_index)), *profiles.time_parts(products.labelled_watches(t))
    )
    return quality.vector_shape_profile(joined, ["embedding", "temporal", "distribution"])


@query("vector_close_check", """
    select status, count(*) as vectors from (
        select video_id, case when video_id > 'f' then 'missing' when video_id < '1' then 'different' else 'close' end as status from avg_vector) group by status""")
def vector_close_check(t):
    """A stored copy with some vectors altered and some lost, against its source."""
    source = profiles.avg_embedding(t.item_index)
    altered = F.when(F.col("video_id") < "1", F.transform("avg_embedding", lambda x: x + 0.01)).otherwise(F.col("avg_embedding"))
    stored = source.where("video_id <= 'f'").withColumn("avg_embedding", altered)
    return quality.vector_close_check(stored, source, "video_id", "avg_embedding").groupBy("status").agg(F.count(F.lit(1)).alias("vectors"))


sql_view("nearest_ten", """
    select * from (select *, row_number() over (partition by content_type, cluster_id, bin, query_video_id order by distance, candidate_video_id) as rn from tier_far)
    where rn <= 10""")


@query("neighbour_count_profile", """
    with q as (select distinct content_type, cluster_id, bin, query_video_id from tier_sampled),
    p as (select q.query_video_id, count(distance) as n, min(distance) as lo, max(distance) as hi, sum(distance) as s from q
          left join nearest_ten d on d.content_type = q.content_type and d.cluster_id = q.cluster_id and d.bin = q.bin and d.query_video_id = q.query_video_id
          group by q.content_type, q.cluster_id, q.bin, q.query_video_id)
    select count(*) as queries, count(*) filter (where n = 0) as without_neighbours, count(*) filter (where n < 10) as short_lists,
           cast(sum(n) as bigint) as neighbours, round(min(lo), 6) as min_distance, round(max(hi), 6) as max_distance, round(sum(s) / sum(n), 6) as mean_distance from p""")
def neighbour_count_profile(t):
    from itemrec.catalog.clusters import nearest_ten

    plan = products.tier_plan(t)
    near = nearest_ten(tiers.tier_distances(plan, products.averages(t), None))
    keys = ["content_type", "cluster_id", "bin", "query_video_id"]
    out = quality.neighbour_count_profile(near, plan.queries.select(*keys), keys)
    for c in ("min_distance", "max_distance", "mean_distance"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("report_count_profile", """
    with c as (select user_id, count(distinct video_id) as n from reported_pair group by user_id)
    select cast(generate_subscripts(q, 1) - 1 as int) as decile, round(unnest(q), 6)::double as items
    from (select quantile_cont(n::double, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as q from c)""")
def report_count_profile(t):
    return quality.report_count_profile(pools.all_reported(t.reports)).withColumn("items", F.round("items", 6))
