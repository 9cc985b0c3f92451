"""Filters, predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemrec.catalog.registry import query
from itemrec.functions import rules
from itemrec.operators import pools
from itemrec.plans import profiles, serve
from itemrec.sources.views import AS_OF


@query("filter_min_watch", """
    select user_id, video_id, round(coalesce(mean_percentage_watched, 0) * 100, 6) as percent from interaction
    where coalesce(mean_percentage_watched, 0) * 100 > 25""")
def filter_min_watch(t):
    return profiles.min_watch(t.interaction).select("user_id", "video_id", F.round("percent", 6).alias("percent"))


@query("filter_min_items_per_user", """
    select user_id, item_id as video_id from watch_event
    where user_id in (select user_id from watch_event group by user_id having count(*) >= 60)""")
def filter_min_items_per_user(t):
    rows = t.watch_event.select("user_id", F.col("item_id").alias("video_id"))
    return profiles.users_with_min_items(rows, 60)


@query("filter_watch_range", "select user_id, video_id, mean_percentage_watched::double as watch_percentage from interaction where mean_percentage_watched >= 0.1")
def filter_watch_range(t):
    return serve.filter_watch_range(t.interaction).select("user_id", "video_id", "watch_percentage")


@query("nsfw_split_label", """
    select video_id, probability, case when probability < 0.4 then false when probability > 0.7 then true end as nsfw_label
    from item_unique left join item_nsfw using (video_id)""")
def nsfw_split_label(t):
    rows = t.item_unique.join(t.item_nsfw.select("video_id", "probability"), "video_id", "left")
    return rows.withColumn("nsfw_label", rules.nsfw_split_label(F.col("probability")))


@query("nsfw_region_label", """
    select video_id, probability, case when probability >= 0.7 then true when probability < 0.4 then false end as nsfw_label
    from item_unique left join item_nsfw using (video_id)""")
def nsfw_region_label(t):
    rows = t.item_unique.join(t.item_nsfw.select("video_id", "probability"), "video_id", "left")
    return rows.withColumn("nsfw_label", rules.nsfw_region_label(F.col("probability")))


@query("nsfw_pool_filter", """
    select video_id, case when coalesce(n.probability, 0.5) > 0.7 and u.is_nsfw then 'nsfw' else 'clean' end as content_type
    from (select distinct regexp_extract(uri, '([a-f0-9]{32})', 1) as video_id, is_nsfw from item_index) u
    left join item_nsfw n using (video_id)
    where (coalesce(n.probability, 0.5) > 0.7 and u.is_nsfw) or (coalesce(n.probability, 0.5) < 0.4 and not u.is_nsfw)""")
def nsfw_pool_filter(t):
    index = t.item_index.select(F.regexp_extract("uri", "([a-f0-9]{32})", 1).alias("video_id"), "is_nsfw").distinct()
    rows = index.join(t.item_nsfw.select("video_id", "probability"), "video_id", "left")
    kind = rules.pool_content_type(F.col("probability"), F.col("is_nsfw"))
    return rows.select("video_id", kind.alias("content_type")).where("content_type is not null")


@query("post_id_opaque_filter", """
    select distinct uri, post_id from item_index
    where post_id is not null and length(post_id) > 5 and try_cast(post_id as bigint) is null""")
def post_id_opaque_filter(t):
    return t.item_index.where(rules.is_opaque_post_id(F.col("post_id"))).select("uri", "post_id").distinct()


@query("uint64_validate", """
    with v as (select uri, post_id as raw from item_index union all select uri, '-' || post_id from item_index
               union all select uri, post_id || '.5' from item_index union all select uri, post_id || '0000000000000000' from item_index)
    select distinct raw, coalesce(regexp_full_match(trim(raw), '[+]?[0-9]+')
           and coalesce(try_cast(trim(raw) as hugeint) between 0 and 18446744073709551615::hugeint, false), false) as valid from v""")
def uint64_validate(t):
    post = F.col("post_id")
    forms = F.array(post, F.concat(F.lit("-"), post), F.concat(post, F.lit(".5")), F.concat(post, F.lit("0" * 16)))
    raw = t.item_index.select(F.explode(forms).alias("raw")).distinct()
    return raw.withColumn("valid", rules.is_uint64(F.col("raw")))


@query("item_id_validate", """
    with v as (select uri as raw from item_index union all select post_id from item_index union all
               select regexp_extract(uri, '([a-f0-9]{32})', 1) from item_index)
    select distinct raw, coalesce(regexp_full_match(raw, '[A-Za-z0-9_-]+') and length(raw) between 8 and 64, false) as valid from v""")
def item_id_validate(t):
    forms = F.array("uri", "post_id", F.regexp_extract("uri", "([a-f0-9]{32})", 1))
    raw = t.item_index.select(F.explode(forms).alias("raw")).distinct()
    return raw.withColumn("valid", rules.is_item_id(F.col("raw")))


@query("drop_null_keys", """
    select distinct uri, post_id, publisher_user_id from item_index
    where uri is not null and post_id is not null and publisher_user_id is not null""")
def drop_null_keys(t):
    keys = ["uri", "post_id", "publisher_user_id"]
    return t.item_index.select(*keys).dropna(subset=keys).distinct()


@query("exclude_test_users", "select reportee_user_id, video_uri, parent_video_uri from reports where reportee_user_id not like '%test%'")
def exclude_test_users(t):
    return t.reports.where(~F.col("reportee_user_id").like("%test%"))


@query("lookback_60d", f"""
    select user_id, video_id from interaction where last_watched_timestamp >= timestamp '{AS_OF}' - interval 60 days
    and user_id is not null and video_id is not null""")
def lookback_60d(t):
    return pools.lookback(t.interaction, AS_OF).select("user_id", "video_id")


@query("positive_score_filter", """
    select video_id, region, try_cast(within_region_popularity_score as double) as score from region_popularity
    where try_cast(within_region_popularity_score as double) > 0""")
def positive_score_filter(t):
    return pools.positive_scores(t.region_popularity)
