"""Window functions and distributed rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from itemrec.catalog import products
from itemrec.catalog.registry import query, sql_view
from itemrec.functions import ids
from itemrec.operators import pools, sessions, similarity, tiers
from itemrec.operators.ranking import top_n, with_percent_rank
from itemrec.plans import profiles


@query("recent_n_per_user", "select user_id, video_id, cast(position as int) as recency from newest_row where position <= 10")
def recent_n_per_user(t):
    return profiles.recent_n_per_user(t.interaction, 10).select("user_id", "video_id", "recency")


@query("ntile_tiers", "select content_type, cluster_id, user_id, total_seconds, items_watched, bin from tier_user")
def ntile_tiers(t):
    return tiers.ntile_tiers(products.watch_time(t))


@query("qcut_tiers", """
    with e as (select content_type, cluster_id, list_sort(list_distinct(list_transform(
               quantile_cont(total_seconds, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 6)))) as edges from tier_seconds group by all)
    select s.content_type, s.cluster_id, user_id, total_seconds, items_watched,
           cast(len(list_filter(edges[2:len(edges) - 1], lambda x: x < total_seconds)) as int) as bin,
           len(list_filter(edges[2:len(edges) - 1], lambda x: x < total_seconds)) / 3.0::double as quantile
    from tier_seconds s join e on e.content_type = s.content_type and e.cluster_id = s.cluster_id""")
def qcut_tiers(t):
    return tiers.qcut_tiers(products.watch_time(t))


@query("percent_rank_users", """
    select content_type, cluster_id, user_id, percent_rank() over (partition by content_type, cluster_id order by total_seconds) as percentile from tier_seconds""")
def percent_rank_users(t):
    ranks = with_percent_rank(products.watch_time(t), ["content_type", "cluster_id"], "total_seconds", [F.col("user_id")], "percentile")
    return ranks.select("content_type", "cluster_id", "user_id", "percentile")


@query("percent_rank_neighbours", """
    select content_type, cluster_id, bin, query_video_id, candidate_video_id, share from (
        select *, percent_rank() over (partition by content_type, cluster_id, bin, query_video_id order by distance) as share from tier_far) where share <= 0.15""")
def percent_rank_neighbours(t):
    """Sampled lists hold at most 200 rows per query, so a plain window is bounded."""
    rows = tiers.tier_distances(products.tier_plan(t), products.averages(t), None)
    w = Window.partitionBy("content_type", "cluster_id", "bin", "query_video_id").orderBy("distance")
    ranks = rows.withColumn("share", F.percent_rank().over(w)).where("share <= 0.15")
    return ranks.select("content_type", "cluster_id", "bin", "query_video_id", "candidate_video_id", "share")


@query("lag_tier", """
    select content_type, cluster_id, bin, prev_cluster_id, prev_bin, num_cx, flag_same_cluster, flag_same_bin, flag_compare from tier_flag""")
def lag_tier(t):
    sizes = products.tier_item_rows(t).groupBy("content_type", "cluster_id", "bin").agg(F.count(F.lit(1)).alias("num_items"))
    return tiers.lag_tier(sizes).drop("num_items")


@query("lag_source_bin", """
    select content_type, cluster_id, bin, source_bin, prev_bin, 'cluster_' || cluster_id || '->bin_' || coalesce(source_bin, 0) || '->bin_' || bin as comparison_flow from tier_source""")
def lag_source_bin(t):
    rows = tiers.with_source_bin(products.tier_pair_rows(t))
    return rows.select("content_type", "cluster_id", "bin", "source_bin", "prev_bin", "comparison_flow")


@query("dedup_pairs", """
    select distinct cluster_id, l.video_id as video_id_x, d.parent_video_id as video_id_y from user_item_cluster l join item_duplicates d on d.original_video_id = l.video_id""")
def dedup_pairs(t):
    """One row per pair by its two columns; a joined text key could clash."""
    pairs = t.user_item_cluster.select("cluster_id", F.col("video_id").alias("video_id_x")).join(
        t.item_duplicates.select(F.col("original_video_id").alias("video_id_x"), F.col("parent_video_id").alias("video_id_y")), "video_id_x"
    )
    return pairs.dropDuplicates(["cluster_id", "video_id_x", "video_id_y"]).select("cluster_id", "video_id_x", "video_id_y")


@query("qualify_top_n", """
    select cluster_id, user_id, video_id, rn from (select cluster_id, user_id, video_id,
           cast(row_number() over (partition by cluster_id, user_id order by md5('pick|' || user_id || '|' || video_id), video_id) as int) as rn from user_item_cluster) where rn <= 30""")
def qualify_top_n(t):
    order = [ids.hash_order("pick", F.col("user_id"), F.col("video_id")), F.col("video_id")]
    return top_n(t.user_item_cluster.select("cluster_id", "user_id", "video_id"), ["cluster_id", "user_id"], order, 30)


sql_view("iou_pair", "select distinct video_id_x as query_video_id, video_id_y as candidate_video_id from iou_candidates")
sql_view("vector_row", """
    select query_video_id, candidate_video_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) as similarity
    from iou_pair join item_vector q on q.video_id = query_video_id join item_vector c on c.video_id = candidate_video_id""")


@query("topk_similar", """
    select query_video_id, candidate_video_id, max(similarity) as similarity from (
        select *, row_number() over (partition by query_video_id order by similarity desc, candidate_video_id) as rn from vector_row) where rn <= 5 group by all""")
def topk_similar(t):
    pairs = products.iou(t).select(F.col("video_id_x").alias("query_video_id"), F.col("video_id_y").alias("candidate_video_id"))
    return similarity.similarity_topk(pairs, products.item_vectors(t), 5)


sql_view("event_session", """
    select user_id, event_id, item_id, ts, cast(sum(case when (epoch_us(ts) - epoch_us(prev)) // 1000000 > 600 then 1 else 0 end)
           over (partition by user_id order by ts, event_id) as bigint) as session_id
    from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from watch_event)""")


@query("sessionize_lag", "select user_id, event_id, session_id from event_session")
def sessionize_lag(t):
    return sessions.sessionize(t.watch_event.drop("event")).select("user_id", "event_id", "session_id")


@query("score_ladder", """
    select nsfw_label, region, video_id, score, row_number() over (partition by nsfw_label, region order by score desc, video_id desc) - 1 as place
    from region_candidate where nsfw_label is not null""")
def score_ladder(t):
    rows = pools.score_ladder(pools.region_candidates(t.region_popularity, t.item_nsfw))
    return rows.select("nsfw_label", "region", "video_id", "score", "place")


@query("query_importance", "select content_type, user_id, query_video_id, cast(pos as int) as pos, n, round(importance, 6) as importance from query_item")
def query_importance(t):
    return products.of_both(lambda c: products.queries_of(t, c)).select("content_type", "user_id", "query_video_id", "pos", "n", F.round("importance", 6).alias("importance"))


