"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemrec.catalog import products
from itemrec.catalog.registry import query, sql_view
from itemrec.functions import ids, rules, sql, vectors
from itemrec.operators import iou, pools, tiers
from itemrec.operators.ranking import paged_lists
from itemrec.operators.split import attach_probability, unique_items_only
from itemrec.plans import profiles, serve
from itemrec.runtime import broadcast_checked
from itemrec.sources.views import AS_OF

sql_view("first_vector", r"""
    select uri, split_part(list_last(string_split(uri, '/')), '.mp4', 1) as video_id, arg_min(embedding, item_timestamp) as embedding
    from item_index where embedding is not null group by uri""")


@query("join_interaction_embedding", """
    select user_id, video_id, mean_percentage_watched, round(embedding[1]::double, 6) as first_value
    from interaction join first_vector using (video_id)""")
def join_interaction_embedding(t):
    rows = profiles.join_embeddings(t.interaction, profiles.first_embedding(t.item_index))
    return rows.select("user_id", "video_id", "mean_percentage_watched", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("join_interaction_embedding_left", """
    select user_id, video_id, round(embedding[1]::double, 6) as first_value
    from interaction left join first_vector using (video_id) where embedding is not null""")
def join_interaction_embedding_left(t):
    rows = profiles.join_embeddings(t.interaction, profiles.first_embedding(t.item_index), "left")
    return rows.select("user_id", "video_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("join_three_vectors", """
    with parts as (
        select user_id, 0 as part, pos::int as pos, r as v from user_average union all select user_id, 1, i::int, r from temporal_mean
        union all select user_id, 2, pos::int, r from cluster_share)
    select user_id, part, count(*)::int as length, round(sum(v), 5) + 0.0 as total, round(sum(v * (pos + 1)), 4) + 0.0 as weighted from parts
    where user_id in (select user_id from parts group by user_id having count(distinct part) = 3) group by user_id, part""")
def join_three_vectors(t):
    """Every part of every user by its length, the sum of its values and their sum weighted by place."""
    joined = profiles.join_three_vectors(
        profiles.user_avg_embedding(products.watches(t), profiles.first_embedding(t.item_index)), *profiles.time_parts(products.labelled_watches(t))
    )
    parts = joined.select("user_id", F.posexplode(F.array("embedding", "temporal", "distribution")).alias("part", "v"))
    weighted = F.transform("v", lambda x, i: x * (i + 1))
    return parts.select(
        "user_id", "part", F.size("v").alias("length"), (F.round(vectors.array_sum(F.col("v")), 5) + 0.0).alias("total"),
        (F.round(vectors.array_sum(weighted), 4) + 0.0).alias("weighted"),
    )


@query("semi_unique_items", "select user_id, video_id from interaction where video_id in (select video_id from item_unique)")
def semi_unique_items(t):
    return unique_items_only(t.interaction, t.item_unique).select("user_id", "video_id")


@query("left_join_nsfw", "select user_id, video_id, probability from interaction left join (select distinct video_id, probability from item_nsfw) using (video_id)")
def left_join_nsfw(t):
    return attach_probability(t.interaction, t.item_nsfw).select("user_id", "video_id", "probability")


# averages stored so far: the items whose id starts with a digit
@query("anti_missing_embeddings", r"""
    with wanted as (select distinct nullif(regexp_extract(uri, '([^/]+)\.mp4$', 1), '') as video_id from item_index)
    select video_id from wanted where video_id is not null
    and not exists (select 1 from item_vector v where v.video_id = wanted.video_id and v.video_id < 'a')""")
def anti_missing_embeddings(t):
    stored = profiles.avg_embedding(t.item_index).where("video_id < 'a'")
    return profiles.missing_embeddings(t.item_index, stored)


sql_view("touched", f"""
    select distinct video_id from interaction where last_watched_timestamp >= timestamp '{AS_OF}' - interval 90 days
    or last_liked_timestamp >= timestamp '{AS_OF}' - interval 90 days or last_shared_timestamp >= timestamp '{AS_OF}' - interval 90 days""")


@query("anti_zero_interaction", "select video_id from item_unique where video_id not in (select video_id from touched)")
def anti_zero_interaction(t):
    return t.item_unique.join(pools.touched_items(t.interaction, AS_OF), "video_id", "left_anti")


@query("cross_percentile", """
    select user_id, cluster_id, total_seconds, p95 from watch_seconds
    join (select cluster_id, quantile_disc(total_seconds, 0.95) as p95 from watch_seconds group by cluster_id) using (cluster_id)
    where total_seconds > p95""")
def cross_percentile(t):
    from itemrec.operators.ranking import discrete_percentiles, ranked

    seconds = tiers.user_watch_time(t.user_item_cluster, ["cluster_id"])
    limits = discrete_percentiles(ranked(seconds, ["cluster_id"], [F.col("total_seconds"), F.col("user_id")]), ["cluster_id"], "total_seconds", {"p95": 0.95})
    joined = seconds.join(broadcast_checked(limits.select("cluster_id", "p95")), "cluster_id")
    return joined.where("total_seconds > p95").select("user_id", "cluster_id", "total_seconds", "p95")


sql_view("iou_base", """
    select content_type, cluster_id, video_id, count(*) filter (where mean_percentage_watched > 0.5) as n_min,
           count(distinct user_id) filter (where mean_percentage_watched > 0.5) as users_min,
           count(distinct user_id) filter (where mean_percentage_watched > 0.75) as users_success,
           list(user_id) filter (where mean_percentage_watched > 0.75) as finished
    from split_interaction where content_type is not null group by content_type, cluster_id, video_id
    having count(distinct user_id) filter (where mean_percentage_watched > 0.5) >= 2
       and count(distinct user_id) filter (where mean_percentage_watched > 0.75) >= 2""")
sql_view("finisher", """
    select content_type, cluster_id, video_id, n_min, unnest(finished) as user_id from iou_base""")
sql_view("scored_pair", """
    select x.content_type, x.cluster_id, x.video_id as video_id_x, y.video_id as video_id_y, any_value(x.n_min + y.n_min) as den, count(*) as num,
           floor(count(*) / any_value(x.n_min + y.n_min) * 100 + 0.5) / 100 * 2 as iou_modified
    from finisher x join (select distinct content_type, cluster_id, video_id, n_min, user_id from finisher) y
      on x.content_type = y.content_type and x.cluster_id = y.cluster_id and x.user_id = y.user_id and x.video_id <> y.video_id
    group by x.content_type, x.cluster_id, x.video_id, y.video_id""")


@query("self_pairs_within_cluster", """
    with a as (select content_type, cluster_id, count(*) as n from iou_base group by all),
    r as (select content_type, cluster_id, iou_modified as score, count(*) as pairs from scored_pair group by all)
    select content_type, cluster_id, score, pairs from r
    union all
    select a.content_type, a.cluster_id, null, cast(any_value(n * (n - 1)) - coalesce(sum(pairs), 0) as bigint)
    from a left join r using (content_type, cluster_id) group by a.content_type, a.cluster_id
    having cast(any_value(n * (n - 1)) - coalesce(sum(pairs), 0) as bigint) > 0""")
def self_pairs_within_cluster(t):
    from itemrec.catalog.products import labelled

    return iou.pair_score_profile(labelled(t))


@query("self_pairs_across_clusters", """
    with b as (select cluster_label, video_id, count(distinct user_id) filter (where mean_percentage_watched > 0.5) as n_min
               from user_item_cluster where cluster_label is not null group by all
               having count(distinct user_id) filter (where mean_percentage_watched > 0.5) >= 2
                  and count(distinct user_id) filter (where mean_percentage_watched > 0.75) >= 2),
    s as (select distinct u.cluster_label, video_id, user_id, n_min from user_item_cluster u join b using (cluster_label, video_id)
          where mean_percentage_watched > 0.75)
    select x.cluster_label as cluster_id_x, y.cluster_label as cluster_id_y, x.video_id as video_id_x, y.video_id as video_id_y,
           any_value(x.n_min + y.n_min) as den, count(*) as num
    from s x join s y on x.user_id = y.user_id and x.cluster_label <> y.cluster_label and x.video_id <> y.video_id
    group by 1, 2, 3, 4""")
def self_pairs_across_clusters(t):
    return iou.pairs_across_clusters(t.user_item_cluster, "cluster_label")


sql_view("avg_vector", """
    select video_id, list(m order by pos) as avg_embedding from (
        select video_id, pos, avg(v) as m from (select video_id, generate_subscripts(embedding, 1) as pos, unnest(embedding) as v from item_vector)
        group by video_id, pos) group by video_id""")


@query("unnest_join", """
    select user_id, page, video_id, round(avg_embedding[1], 6) as first_value from (
        select user_id, video_id, cast((row_number() over (partition by user_id order by last_watched_timestamp, video_id) - 1) // 1000 as int) as page
        from user_item_cluster) join avg_vector using (video_id)""")
def unnest_join(t):
    lists = profiles.collect_engagement(t.user_item_cluster)
    items = lists.select("user_id", "page", F.explode("items.video_id").alias("video_id"))
    rows = items.join(profiles.avg_embedding(t.item_index), "video_id")
    return rows.select("user_id", "page", "video_id", F.round(F.col("avg_embedding")[0], 6).alias("first_value"))


@query("distance_theta_join", """
    select content_type, cluster_id, bin, query_video_id, candidate_video_id, round(distance, 6) as distance from tier_far where distance < 0.5""")
def distance_theta_join(t):
    near = tiers.tier_distances(products.tier_plan(t), products.averages(t), 0.5)
    return near.select("content_type", "cluster_id", "bin", "query_video_id", "candidate_video_id", F.round("distance", 6).alias("distance"))


# whole lists are compared by their digest
@query("expand_pool_to_queries", """
    select q.content_type, q.user_id, query_video_id, type_num, count(*) as candidates, md5(string_agg(video_id, ',' order by video_id)) as digest
    from query_item q join user_pool p on p.content_type = q.content_type and p.user_id = q.user_id group by all""")
def expand_pool_to_queries(t):
    def build(content):
        s = products.Served(t, content)
        listed = F.col("candidates")
        return serve.expand_pool_to_queries(s.pools, s.keys, s.queries, number=F.size(listed).cast("bigint"), digest=F.md5(F.array_join(listed, ",")))

    return products.of_both(build).select("content_type", "user_id", "query_video_id", "type_num", F.col("number").alias("candidates"), "digest")


@query("join_tier_bin", """
    select user_id, cluster_id, total_seconds, user_count, case when total_seconds <= percentile_25 then 0 when total_seconds <= percentile_50 then 1
        when total_seconds <= percentile_75 then 2 when total_seconds <= percentile_100 then 3 else -1 end as bin
    from watch_seconds join plain_bins using (cluster_id)""")
def join_tier_bin(t):
    seconds = tiers.user_watch_time(t.user_item_cluster, ["cluster_id"])
    joined = seconds.join(broadcast_checked(tiers.tier_bins(seconds, ["cluster_id"])), "cluster_id")
    cuts = [F.col(c) for c in ("total_seconds", "percentile_25", "percentile_50", "percentile_75", "percentile_100")]
    return joined.select("user_id", "cluster_id", "total_seconds", "user_count", rules.tier_of_strict(*cuts).alias("bin"))


@query("lookup_candidates", """
    select q.content_type, user_id, query_video_id, video_id_y as candidate_video_id from query_item q
    left join iou_candidates c on c.content_type = q.content_type and c.cluster_id = q.cluster_id and c.video_id_x = q.query_video_id""")
def lookup_candidates(t):
    """A row for each stored candidate of a query item, or one without; an item's candidates have no bound."""
    def build(content):
        stored = products.iou_table(t).where(F.col("content_type") == content).select(
            "cluster_id", F.col("video_id_x").alias("query_video_id"), F.col("video_id_y").alias("candidate_video_id")
        )
        queries = products.queries_of(t, content).select("user_id", "cluster_id", "query_video_id")
        return queries.join(stored, ["cluster_id", "query_video_id"], "left").select("user_id", "query_video_id", "candidate_video_id")

    return products.of_both(build)


@query("lookup_post_mapping", """
    select distinct i.uri, case when m.post_id is null or m.canister_id is null then i.canister_id else m.canister_id end as canister_id,
           case when m.post_id is null or m.canister_id is null then i.post_id else m.post_id end as post_id
    from item_index i left join post_mapping m on m.old_canister_id = i.canister_id and m.old_post_id = i.post_id""")
def lookup_post_mapping(t):
    pairs = t.item_index.select("uri", "canister_id", "post_id").distinct()
    return serve.apply_post_mapping(pairs, t.post_mapping)


sql_view("view_counts", "select item_id, count(*) filter (where logged_in) as total_count_loggedin, count(*) as total_count_all from view_event group by item_id")


@query("lookup_view_counts", """
    select u.video_id, coalesce(total_count_loggedin, 0) as num_views_loggedin, coalesce(total_count_all, 0) as num_views_all
    from item_unique u left join view_counts v on v.item_id = u.video_id""")
def lookup_view_counts(t):
    counts = serve.view_counts(t.view_event).withColumnRenamed("item_id", "video_id")
    return t.item_unique.join(counts, "video_id", "left").select(
        "video_id", F.coalesce("total_count_loggedin", F.lit(0)).alias("num_views_loggedin"), F.coalesce("total_count_all", F.lit(0)).alias("num_views_all")
    )


@query("lookup_nsfw_probability", "select video_id, coalesce(probability, 0.0::double) as nsfw_probability from item_unique left join item_nsfw using (video_id)")
def lookup_nsfw_probability(t):
    rows = t.item_unique.join(t.item_nsfw.select("video_id", "probability"), "video_id", "left")
    return rows.select("video_id", F.coalesce("probability", F.lit(0.0)).alias("nsfw_probability"))


@query("item_url_lookup", r"""
    with known as (select distinct regexp_extract(uri, '([^/]+)\.mp4$', 1) as video_id,
                   'https://items.example/watch/' || canister_id || '/' || post_id as url from item_index where regexp_extract(uri, '([^/]+)\.mp4$', 1) <> ''),
    newest as (select user_id, video_id, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as rn from interaction)
    select user_id, rn as position, video_id, url from newest left join known using (video_id)""")
def item_url_lookup(t):
    page = 20
    lists = paged_lists(t.interaction, ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")], F.col("video_id"), page)
    urls = item_urls(lists.withColumnRenamed("items", "video_ids"), t.item_index, ("user_id", "page"))
    long = urls.select("user_id", "page", F.posexplode("urls").alias("p", "u"))
    return long.select("user_id", (F.col("page") * page + F.col("p") + 1).cast("bigint").alias("position"), "u.video_id", "u.url")


@query("sql_functions", r"""
    with known as (select distinct regexp_extract(uri, '([^/]+)\.mp4$', 1) as video_id,
                   'https://items.example/watch/' || canister_id || '/' || post_id as url from item_index where regexp_extract(uri, '([^/]+)\.mp4$', 1) <> '')
    select user_id, i.video_id, url, 'gs://items/' || i.video_id || '.mp4' as uri, floor(mean_percentage_watched::double * 100 + 0.5) / 100 as watched,
           case when is_nsfw then 'nsfw' when not is_nsfw then 'clean' end as content_type
    from interaction i left join known k on k.video_id = i.video_id left join item_nsfw n on n.video_id = i.video_id""")
def sql_functions(t):
    """The id rules and the lookup of urls, used from SQL text."""
    sql.register(t.spark, t.item_index)
    return t.spark.sql("""
        select i.user_id, i.video_id, u.url, uri_from_item_id(item_id_strict(uri_from_item_id(i.video_id, 'items')), 'items') as uri,
               round2(i.mean_percentage_watched) as watched, content_type_of(n.is_nsfw) as content_type
        from {rows} i left join lateral urls_of(i.video_id) u left join {labels} n on n.video_id = i.video_id""", rows=t.interaction, labels=t.item_nsfw)


def item_urls(lists, index, keys=("user_id",)):
    """Lists of ids (bounded by the caller) to lists of (id, url), unknown ids kept with no url."""
    url = ids.item_url("https://items.example/watch", F.col("canister_id"), F.col("post_id"))
    known = index.select(ids.item_id_strict(F.col("uri")).alias("video_id"), url.alias("url")).where("video_id is not null").distinct()
    long = lists.select(*keys, F.posexplode_outer("video_ids").alias("pos", "video_id")).join(known, "video_id", "left")
    rows = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "video_id", "url"))).alias("l"))
    return rows.select(*keys, F.transform("l", lambda s: F.struct(s["video_id"].alias("video_id"), s["url"].alias("url"))).alias("urls"))


@query("missing_embedding_report", """
    select distinct video_id, case when v.known is null then 'Missing' else 'Found' end as embedding_status
    from interaction left join (select distinct video_id, true as known from item_vector) v using (video_id)""")
def missing_embedding_report(t):
    known = profiles.keyed_vectors(t.item_index).select("video_id").distinct().withColumn("known", F.lit(True))
    rows = t.interaction.select("video_id").distinct().join(known, "video_id", "left")
    return rows.select("video_id", F.when(F.col("known").isNull(), "Missing").otherwise("Found").alias("embedding_status"))

