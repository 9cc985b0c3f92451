"""Scalar, array, JSON and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemrec.catalog.registry import query, sql_view
from itemrec.functions import ids, rules, vectors
from itemrec.operators import sessions
from itemrec.operators.ranking import top_n
from itemrec.plans import profiles

BASE = "https://items.example/watch"

# every distinct uri of the index, the reports included
sql_view("all_uris", "select distinct uri from (select uri from item_index union all select video_uri as uri from reports)")


def all_uris(t):
    return t.item_index.select("uri").union(t.reports.select("video_uri")).distinct()


@query("fn_item_id_strict", r"select uri, nullif(regexp_extract(uri, '([^/]+)\.mp4$', 1), '') as video_id from all_uris")
def fn_item_id_strict(t):
    return all_uris(t).select("uri", ids.item_id_strict(F.col("uri")).alias("video_id"))


@query("fn_item_id_lenient", "select uri, split_part(list_last(string_split(uri, '/')), '.mp4', 1) as video_id from all_uris")
def fn_item_id_lenient(t):
    return all_uris(t).select("uri", ids.item_id_lenient(F.col("uri")).alias("video_id"))


@query("fn_item_id_passthrough", """
    select uri, case when contains(uri, '.mp4') then split_part(list_last(string_split(uri, '/')), '.mp4', 1) else uri end as video_id
    from all_uris""")
def fn_item_id_passthrough(t):
    return all_uris(t).select("uri", ids.item_id_passthrough(F.col("uri")).alias("video_id"))


@query("fn_item_id_hex32", r"select uri, nullif(regexp_extract(uri, 'gs://items/([a-f0-9]{32})\.mp4', 1), '') as video_id from all_uris")
def fn_item_id_hex32(t):
    return all_uris(t).select("uri", ids.item_id_hex32(F.col("uri"), "items").alias("video_id"))


@query("fn_uri_from_item_id", "select video_id, 'gs://items/' || video_id || '.mp4' as uri from item_nsfw")
def fn_uri_from_item_id(t):
    return t.item_nsfw.select("video_id", ids.uri_from_item_id(F.col("video_id"), "items").alias("uri"))


@query("fn_uri_endswith", """
    select uri, ends_with(uri, '/' || regexp_extract(uri, '([a-f0-9]{32})', 1) || '.mp4') as matches from all_uris""")
def fn_uri_endswith(t):
    hex_part = F.regexp_extract("uri", "([a-f0-9]{32})", 1)
    return all_uris(t).select("uri", ids.uri_matches_item(F.col("uri"), hex_part).alias("matches"))


@query("fn_cache_key", """
    select distinct cluster_id, user_id, 'clean:' || cluster_id || ':' || user_id || ':watch_time' as cache_key from user_cluster""")
def fn_cache_key(t):
    key = ids.cache_key(F.lit("clean"), F.col("cluster_id"), F.col("user_id"), F.lit("watch_time"))
    return t.user_cluster.select("cluster_id", "user_id", key.alias("cache_key"))


@query("fn_flow_label", """
    select distinct cluster_id, cluster_label,
           'cluster_' || cluster_id || '->bin_' || coalesce(nullif(cluster_label, 3), 0) || '->bin_' || (cluster_label + 1) as flow
    from user_item_cluster where cluster_label is not null""")
def fn_flow_label(t):
    source = F.when(F.col("cluster_label") != 3, F.col("cluster_label"))
    flow = ids.flow_label(F.col("cluster_id"), source, F.col("cluster_label") + 1)
    rows = t.user_item_cluster.where("cluster_label is not null").select("cluster_id", "cluster_label").distinct()
    return rows.select("cluster_id", "cluster_label", flow.alias("flow"))


@query("fn_item_url", """
    select distinct uri, case when canister_id is not null and post_id is not null
           then 'https://items.example/watch/' || canister_id || '/' || post_id end as url from item_index""")
def fn_item_url(t):
    return t.item_index.select("uri", ids.item_url(BASE, F.col("canister_id"), F.col("post_id")).alias("url")).distinct()


@query("fn_parse_event", """
    select event_id, item_id as video_id, least(value, 100.0)::double as percent_watched,
           'pub' || (e.user_id % 40) as publisher_user_id, strftime(date_trunc('second', e.ts), '%Y-%m-%d %H:%M:%S') as watched_at
    from watch_event w join events e using (event_id) where event_id % 101 <> 0""")
def fn_parse_event(t):
    parsed = t.watch_event.select("event_id", rules.parse_event(F.col("event")).alias("e")).where("e.video_id is not null")
    stamp = F.date_format(F.timestamp_seconds("e.timestamp.secs_since_epoch"), "yyyy-MM-dd HH:mm:ss")
    return parsed.select("event_id", "e.video_id", "e.percent_watched", "e.publisher_user_id", stamp.alias("watched_at"))


sql_view("watch_seconds", """
    select cluster_id, user_id, round(sum(mean_percentage_watched) * 60, 6) as total_seconds, count(*) as items_watched
    from user_item_cluster group by cluster_id, user_id""")
sql_view("plain_bins", """
    select cluster_id, quantile_disc(total_seconds, 0.25) as percentile_25, quantile_disc(total_seconds, 0.5) as percentile_50,
           quantile_disc(total_seconds, 0.75) as percentile_75, max(total_seconds) as percentile_100, count(*) as user_count
    from watch_seconds group by cluster_id""")


def _with_bins(t):
    from itemrec.operators.tiers import tier_bins, user_watch_time
    from itemrec.runtime import broadcast_checked

    seconds = user_watch_time(t.user_item_cluster, ["cluster_id"])
    return seconds.join(broadcast_checked(tier_bins(seconds, ["cluster_id"])), "cluster_id")


_TIER_SQL = """case when total_seconds <= percentile_25 then 0 when total_seconds <= percentile_50 then 1
    when total_seconds <= percentile_75 then 2 else 3 end"""


@query("fn_tier_of", f"select user_id, {_TIER_SQL} as bin from watch_seconds join plain_bins using (cluster_id)")
def fn_tier_of(t):
    bins = [F.col(c) for c in ("total_seconds", "percentile_25", "percentile_50", "percentile_75")]
    return _with_bins(t).select("user_id", rules.tier_of(*bins).alias("bin"))


@query("fn_tier_of_strict", f"""
    select user_id, case when total_seconds > percentile_100 * 0.9 then -1 else {_TIER_SQL} end as bin
    from watch_seconds join plain_bins using (cluster_id)""")
def fn_tier_of_strict(t):
    bins = [F.col(c) for c in ("total_seconds", "percentile_25", "percentile_50", "percentile_75")]
    return _with_bins(t).select("user_id", rules.tier_of_strict(*bins, F.col("percentile_100") * F.lit(0.9)).alias("bin"))


sql_view("item_vector", r"""
    select nullif(regexp_extract(uri, '([^/]+)\.mp4$', 1), '') as video_id, embedding::double[] as embedding, item_timestamp
    from item_index where embedding is not null and regexp_extract(uri, '([^/]+)\.mp4$', 1) <> ''""")
sql_view("vector_pair", """
    select a.video_id, a.embedding as a, b.embedding as b from item_vector a join item_vector b using (video_id)
    where a.item_timestamp < b.item_timestamp""")


def vector_pair(t):
    rows = profiles.keyed_vectors(t.item_index).withColumn("embedding", vectors.as_double(F.col("embedding")))
    ends = rows.groupBy("video_id").agg(
        F.min_by("embedding", "item_timestamp").alias("a"), F.max_by("embedding", "item_timestamp").alias("b")
    )
    return ends


@query("fn_cosine_distance", "select video_id, round(1 - list_cosine_similarity(a, b), 6) as distance from vector_pair")
def fn_cosine_distance(t):
    return vector_pair(t).select("video_id", F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("fn_cosine_similarity", "select video_id, round(list_cosine_similarity(a, b), 6) as similarity from vector_pair")
def fn_cosine_similarity(t):
    return vector_pair(t).select("video_id", F.round(vectors.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def elements(df, key, column):
    """Long form of a vector column, rounded, for comparison."""
    return df.select(key, F.posexplode(column).alias("pos", "value")).select(key, "pos", (F.round("value", 6) + F.lit(0.0)).alias("value"))



@query("fn_l2_normalise", """
    with n as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as s from embeddings)
    select vec_id, cast(generate_subscripts(e, 1) - 1 as int) as pos, round(unnest(e) / s, 6) + 0.0 as value from n""")
def fn_l2_normalise(t):
    unit = t.embeddings.select("vec_id", vectors.l2_normalise(vectors.as_double(F.col("embedding"))).alias("v"))
    return elements(unit, "vec_id", "v")


@query("fn_concat_vectors", """
    with c as (select video_id, list_concat(a, b) as v from vector_pair)
    select video_id, len(v) as length, round(list_sum(v), 5) as total from c""")
def fn_concat_vectors(t):
    merged = vector_pair(t).select("video_id", vectors.concat_vectors(F.col("a"), F.col("b")).alias("v"))
    return merged.select("video_id", F.size("v").cast("bigint").alias("length"), F.round(vectors.array_sum(F.col("v")), 5).alias("total"))


# ---- time-position vectors ---------------------------------------------------------------------

sql_view("time_bounds", "select min(last_watched_timestamp) as lo, max(last_watched_timestamp) as hi from user_item_cluster")
sql_view("temporal_counts", """
    select user_id, cluster_label,
           cast(least(floor(((epoch(last_watched_timestamp) - epoch(lo)) / 86400.0::double)
                / ((epoch(hi) - epoch(lo)) / 86400.0::double / 16)), 15) as int) as time_bin,
           count(*) as n
    from user_item_cluster, time_bounds where cluster_label is not null group by all""")
sql_view("rope_basis", """
    select c as cluster_label, p as time_bin, i,
           case when i % 2 = 0 then b * cos(angle) - partner * sin(angle) else partner * sin(angle) + b * cos(angle) end as r
    from (select c, i, b / sqrt(sum(b * b) over (partition by c)) as b,
                 partner / sqrt(sum(b * b) over (partition by c)) as partner
          from (select c, i, sin(c * (i + 1) / 16.0::double) * 0.5 + 0.5 as b,
                       sin(c * ((case when i % 2 = 0 then i + 1 else i - 1 end) + 1) / 16.0::double) * 0.5 + 0.5 as partner
                from range(10) x(c), range(16) y(i))) base,
         (select p, j, p * pow(10000.0::double, -(j - j % 2) / 16.0::double) as angle from range(16) z(p), range(16) w(j)) turn
    where turn.j = base.i""")
sql_view("rope_cluster", """
    select user_id, cluster_label, i, v / sqrt(sum(v * v) over (partition by user_id, cluster_label)) as r
    from (select user_id, t.cluster_label, i, sum(n * r) as v from temporal_counts t
          join rope_basis b on b.cluster_label = t.cluster_label and b.time_bin = t.time_bin
          group by user_id, t.cluster_label, i)""")


@query("fn_rope_cluster", "select user_id, cluster_label, cast(i as int) as pos, round(r, 6) + 0.0 as value from rope_cluster")
def fn_rope_cluster(t):
    rope = profiles.rope_by_cluster(profiles.temporal_counts(t.user_item_cluster))
    long = rope.select("user_id", "cluster_label", F.posexplode("rope").alias("pos", "value"))
    return long.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("fn_rope_position", """
    with f as (
        select user_id, i, sum(n * case when i % 2 = 0 then sin(theta) else cos(theta) end) as v
        from (select user_id, time_bin, sum(n) as n from temporal_counts group by all) c,
             (select b, i, (b / 16.0::double) / pow(10000.0::double, 2 * (i // 2) / 16.0::double) as theta from range(16) x(b), range(16) y(i)) p
        where p.b = c.time_bin group by user_id, i)
    select user_id, cast(i as int) as pos, round(v / sqrt(sum(v * v) over (partition by user_id)), 6) + 0.0 as value from f""")
def fn_rope_position(t):
    return elements(profiles.rope_position(profiles.temporal_counts(t.user_item_cluster)), "user_id", "temporal")


sql_view("temporal_mean", """
    select user_id, i, v / sqrt(sum(v * v) over (partition by user_id)) as r
    from (select user_id, i, sum(r) / 10 as v from rope_cluster group by user_id, i)""")


@query("fn_temporal_mean", "select user_id, cast(i as int) as pos, round(r, 6) + 0.0 as value from temporal_mean")
def fn_temporal_mean(t):
    rope = profiles.rope_by_cluster(profiles.temporal_counts(t.user_item_cluster))
    return elements(profiles.temporal_mean(rope), "user_id", "temporal")


@query("fn_temporal_concat", """
    with g as (select user_id, c, i from (select distinct user_id from rope_cluster), range(10) x(c), range(16) y(i)),
    d as (select g.user_id, c * 16 + g.i as pos, coalesce(r, 0.0::double) as r from g left join rope_cluster k on k.user_id = g.user_id and cluster_label = c and k.i = g.i)
    select user_id, cast(pos as int) as pos, round(r / sqrt(sum(r * r) over (partition by user_id)), 6) + 0.0 as value from d""")
def fn_temporal_concat(t):
    rope = profiles.rope_by_cluster(profiles.temporal_counts(t.user_item_cluster))
    return elements(profiles.temporal_concat(rope), "user_id", "temporal")


# ---- arrays and building blocks -----------------------------------------------------------------

@query("fn_array_distinct", """
    select vec_id, len(list_distinct(list_transform(embedding, lambda x: cast(floor(x * 10) as int)))) as levels from embeddings""")
def fn_array_distinct(t):
    levels = F.transform("embedding", lambda x: F.floor(x * 10).cast("int"))
    return t.embeddings.select("vec_id", F.size(F.array_distinct(levels)).cast("bigint").alias("levels"))


@query("fn_array_len", "select vec_id, len(embedding) as length from embeddings")
def fn_array_len(t):
    return t.embeddings.select("vec_id", F.size("embedding").cast("bigint").alias("length"))


@query("fn_unnest_pos", """
    select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, unnest(embedding)::double as value from embeddings""")
def fn_unnest_pos(t):
    return t.embeddings.select("vec_id", F.posexplode(vectors.as_double(F.col("embedding"))).alias("pos", "value"))


@query("fn_array_ordered_limit", """
    select user_id, string_agg(video_id, ',' order by rn) as newest from (
        select user_id, video_id, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as rn
        from interaction) where rn <= 10 group by user_id""")
def fn_array_ordered_limit(t):
    rows = top_n(t.interaction, ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")], 10)
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "video_id"))).alias("l"))
    return lists.select("user_id", F.array_join(F.transform("l", lambda s: s["video_id"]), ",").alias("newest"))


@query("fn_chunk_list", """
    with n as (select vec_id, 1 + vec_id % 23 as n from embeddings),
    c as (select vec_id, n, case when n < 2 then 0 when (n + 4) // 5 > 1 and n - ((n + 4) // 5 - 1) * 5 < 2 then (n + 4) // 5 - 1
                 else (n + 4) // 5 end as k from n)
    select vec_id, cast(j as int) as chunk, cast(case when j = k - 1 then n - j * 5 else 5 end as int) as length,
           round((embedding[j * 5 + 1])::double, 6) as first_value
    from c join embeddings using (vec_id), range(6) r(j) where j < k""")
def fn_chunk_list(t):
    cut = t.embeddings.select("vec_id", sessions.chunk_list(F.expr("slice(embedding, 1, cast(1 + vec_id % 23 as int))")).alias("c"))
    chunks = cut.select("vec_id", F.posexplode("c").alias("chunk", "v"))
    return chunks.select("vec_id", "chunk", F.size("v").alias("length"), F.round(F.col("v")[0].cast("double"), 6).alias("first_value"))


@query("fn_safe_cast", """
    select distinct post_id, try_cast(post_id as bigint) as as_bigint, try_cast(post_id as double) as as_double from item_index""")
def fn_safe_cast(t):
    post = F.col("post_id")
    return t.item_index.select("post_id", post.try_cast("bigint").alias("as_bigint"), post.try_cast("double").alias("as_double")).distinct()


@query("fn_coalesce", """
    select video_id, coalesce(n.probability, 0.5::double) as probability, coalesce(n.is_nsfw, false) as is_nsfw
    from item_unique left join item_nsfw n using (video_id)""")
def fn_coalesce(t):
    rows = t.item_unique.join(t.item_nsfw, "video_id", "left")
    return rows.select("video_id", F.coalesce("probability", F.lit(0.5)).alias("probability"), F.coalesce("is_nsfw", F.lit(False)).alias("is_nsfw"))


@query("fn_round2", "select distinct l_discount, l_quantity, floor(l_quantity / (l_discount * 100 + 7) * 100 + 0.5) / 100 as ratio from lineitem")
def fn_round2(t):
    ratio = rules.round2(F.col("l_quantity") / (F.col("l_discount") * 100 + 7))
    return t.lineitem.select("l_discount", "l_quantity", ratio.alias("ratio")).distinct()


@query("fn_countif", """
    select cluster_id, count(*) filter (where liked) as liked, count(*) filter (where not shared) as unshared
    from user_item_cluster group by cluster_id""")
def fn_countif(t):
    return t.user_item_cluster.groupBy("cluster_id").agg(F.count_if("liked").alias("liked"), F.count_if(~F.col("shared")).alias("unshared"))


@query("fn_interval", """
    select count(*) as num_rows, count(distinct user_id) as users from interaction
    where last_watched_timestamp >= timestamp '2001-11-05' - interval 90 days""")
def fn_interval(t):
    recent = t.interaction.where(F.col("last_watched_timestamp") >= F.lit("2001-11-05").cast("timestamp") - F.expr("interval 90 days"))
    return recent.agg(F.count(F.lit(1)).alias("num_rows"), F.countDistinct("user_id").alias("users"))


@query("fn_default_canister", """
    select uri, item_timestamp = timestamp '2001-01-01' as first_copy,
           case when trim(coalesce(canister_id, '')) = '' then 'default-canister' else canister_id end as canister_id from item_index""")
def fn_default_canister(t):
    first = F.col("item_timestamp") == F.lit("2001-01-01").cast("timestamp")
    return t.item_index.select("uri", first.alias("first_copy"), rules.default_canister(F.col("canister_id")).alias("canister_id"))
