"""Composite jobs: candidates, pools, serving."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.catalog.registry import query, sql_view
from itemrec.functions import rules
from itemrec.operators import iou as iou_ops
from itemrec.operators import pools, tiers
from itemrec.operators import split as split_ops
from itemrec.operators.ranking import ranked
from itemrec.plans import profiles, serve
from itemrec.runtime import store
from itemrec.sources.views import AS_OF, WATCHED, Tables

CONTENTS = ("clean", "nsfw")


def of_both(build) -> DataFrame:
    """Rows of both content types; ``build`` gives those of one."""
    return reduce(DataFrame.unionByName, [build(c).withColumn("content_type", F.lit(c)) for c in CONTENTS])


# ---- shared stages -----------------------------------------------------------------------------

def split(t: Tables) -> DataFrame:
    return split_ops.split_interactions(t.user_item_cluster, t.item_unique, t.item_nsfw)


def labelled(t: Tables) -> DataFrame:
    """Labelled interactions as a stored table, the input of every later stage."""
    return t.stage("labelled", lambda: split(t).where("content_type is not null").select(
        "content_type", "cluster_id", "user_id", "video_id", "mean_percentage_watched", "last_watched_timestamp"
    ))


def iou(t: Tables) -> DataFrame:
    return iou_ops.iou_candidates(labelled(t))


def watches(t: Tables) -> DataFrame:
    """Who watched what, when and how much, for the steps that make vectors of users."""
    return t.watched("interaction", "user_id", "video_id", *WATCHED)


def labelled_watches(t: Tables) -> DataFrame:
    """The same with the clusters of items; a row for each vector that an item's key leads to."""
    return t.watched("user_item_cluster", "user_id", "video_id", "cluster_label", *WATCHED)


def watch_time(t: Tables) -> DataFrame:
    return tiers.user_watch_time(labelled(t))


def tier_item_rows(t: Tables) -> DataFrame:
    return t.stage("tier_items", lambda: tiers.tier_items(labelled(t), tiers.ntile_tiers(watch_time(t))))


def tier_pair_rows(t: Tables) -> DataFrame:
    return t.stage("tier_pairs", lambda: tiers.tier_pairs(tier_item_rows(t)))


def tier_plan(t: Tables) -> tiers.SamplePlan:
    return tiers.sample_plan(tier_item_rows(t), tier_pair_rows(t), "tier")


def averages(t: Tables) -> Callable[[DataFrame], DataFrame]:
    """Average vectors of wanted items, stored for the steps that read them."""
    return lambda wanted: store(profiles.avg_embedding(t.item_index, wanted))


def tier(t: Tables) -> DataFrame:
    return tiers.tier_candidates(tier_item_rows(t), tier_pair_rows(t), averages(t))


def tier_table(t: Tables) -> DataFrame:
    return t.stage("tier_candidates", lambda: tier(t))


def iou_table(t: Tables) -> DataFrame:
    return t.stage("iou_candidates", lambda: iou(t))


def content_rows(t: Tables, content: str) -> DataFrame:
    return labelled(t).where(F.col("content_type") == content)


def profile_of(t: Tables, content: str) -> DataFrame:
    def build() -> DataFrame:
        rows = content_rows(t, content)
        bins = tiers.tier_bins(tiers.user_watch_time(rows, ["cluster_id"]), ["cluster_id"])
        return serve.user_metadata(t.user_region, rows, bins)

    return t.stage(f"profile_{content}", build)


def queries_of(t: Tables, content: str) -> DataFrame:
    def build() -> DataFrame:
        profile = profile_of(t, content).where("cluster_id >= 0 and bin >= 0").select("user_id", "cluster_id", "bin")
        return serve.query_items(serve.newest_history(content_rows(t, content))).join(profile, "user_id")

    return t.stage(f"queries_{content}", build)


def region_rows(t: Tables, content: str) -> DataFrame:
    both = t.stage("region_candidates", lambda: pools.region_candidates(t.region_popularity, t.item_nsfw))
    candidates = both.where(F.col("nsfw_label") == (content == "nsfw"))
    return pools.region_topk(candidates, serve.TOP_K, keys=("region",))


def popular_rows(t: Tables, content: str) -> DataFrame:
    rows = t.stage("popular", lambda: pools.popular_pool(t.item_index, t.item_nsfw, "items"))
    return rows.where(F.col("content_type") == content)


def untouched_rows(t: Tables, content: str) -> DataFrame:
    rows = t.stage("untouched", lambda: pools.untouched_pool(t.item_index, t.item_nsfw, t.item_unique, t.interaction, "2002-01-20 00:00:00"))
    return rows.where(F.col("content_type") == content)


def pools_of(t: Tables, content: str, tier_rows: DataFrame, iou_rows: DataFrame) -> DataFrame:
    cluster = pools.cluster_fallback_pool(tier_rows, iou_rows).where(F.col("content_type") == content)
    worldwide = popular_rows(t, content).where(F.col("position") <= serve.POOL_SAMPLE).select("video_id").unionByName(
        untouched_rows(t, content).where(F.col("position") <= pools.UNTOUCHED_PICK).select("video_id")
    )
    return t.stage(f"pools_{content}", lambda: serve.shared_pools(cluster, region_rows(t, content), worldwide))


def user_keys(t: Tables, content: str) -> DataFrame:
    served = profile_of(t, content).where("cluster_id >= 0 and bin >= 0").join(t.user_region, "user_id")
    return t.stage(f"user_keys_{content}", lambda: serve.user_pool_keys(served))


def item_vectors(t: Tables) -> DataFrame:
    return profiles.keyed_vectors(t.item_index).select("video_id", "embedding")


class Served:
    """Every stage of serving one content type once, for the queries below."""

    def __init__(self, t: Tables, content: str):
        self.tier = tier_table(t).where(F.col("content_type") == content)
        self.iou = iou_table(t).where(F.col("content_type") == content)
        self.queries = queries_of(t, content)
        self.keys = user_keys(t, content)
        self.pools = pools_of(t, content, self.tier, self.iou)
        self.vectors = item_vectors(t)

    def scored(self) -> serve.Scored:
        return serve.score_candidates(self.queries, self.keys, self.tier, self.iou, self.pools, self.vectors)


def content_view(name: str, text: str) -> None:
    """A view for each content type, in which @ stands for the type, and one of both with a column for it."""
    for content in CONTENTS:
        sql_view(f"{name}_{content}", text.replace("@", content))
    sql_view(name, " union all ".join(f"select '{c}' as content_type, * from {name}_{c}" for c in CONTENTS))


# ---- comparison SQL ------------------------------------------------------------------------------

sql_view("split_interaction", """
    select user_id, video_id, last_watched_timestamp, mean_percentage_watched, liked, last_liked_timestamp, shared, last_shared_timestamp,
           cluster_id, updated_at, probability,
           case when probability < 0.4 then false when probability > 0.7 then true end as nsfw_label,
           case when probability < 0.4 then 'clean' when probability > 0.7 then 'nsfw' end as content_type
    from user_item_cluster left join (select distinct video_id, probability from item_nsfw) using (video_id)
    where video_id in (select video_id from item_unique)""")
sql_view("iou_candidates", """
    select s.content_type, s.cluster_id, video_id_x, video_id_y, den, num, iou_modified from scored_pair s
    join (select content_type, cluster_id, quantile_disc(iou_modified, 0.95) as p95 from scored_pair group by all) p
      on p.content_type = s.content_type and p.cluster_id = s.cluster_id where iou_modified > p95""")
sql_view("tier_seconds", """
    select content_type, cluster_id, user_id, round(sum(mean_percentage_watched) * 60, 6) as total_seconds, count(*) as items_watched
    from split_interaction where content_type is not null group by all""")
sql_view("tier_bound", """
    select content_type, cluster_id, quantile_disc(total_seconds, 0.25) as percentile_25, quantile_disc(total_seconds, 0.5) as percentile_50,
           quantile_disc(total_seconds, 0.75) as percentile_75, max(total_seconds) as percentile_100, count(*) as user_count
    from tier_seconds group by all""")
sql_view("tier_user", """
    select content_type, cluster_id, user_id, total_seconds, items_watched,
           cast(ntile(4) over (partition by content_type, cluster_id order by total_seconds, user_id) - 1 as int) as bin from tier_seconds""")
sql_view("tier_item", """
    select distinct s.content_type, s.cluster_id, bin, video_id from split_interaction s
    join tier_user u on u.content_type = s.content_type and u.cluster_id = s.cluster_id and u.user_id = s.user_id""")
sql_view("tier_flow", """
    select content_type, cluster_id, bin, num_cy,
           lag(cluster_id) over w as prev_cluster_id, lag(bin) over w as prev_bin, coalesce(lag(num_cy) over w, 0) as num_cx,
           coalesce(lag(cluster_id) over w = cluster_id, false) as flag_same_cluster, coalesce(lag(bin) over w = bin, false) as flag_same_bin
    from (select content_type, cluster_id, bin, count(*) as num_cy from tier_item group by all)
    window w as (partition by content_type order by cluster_id, bin)""")
sql_view("tier_flag", """
    select *, case when not flag_same_cluster and not flag_same_bin then false when flag_same_cluster and not flag_same_bin then true end as flag_compare
    from tier_flow""")
sql_view("tier_progression", """
    select f.content_type, f.cluster_id, f.bin, p.video_id from tier_flag f
    join tier_item p on p.content_type = f.content_type and p.cluster_id = f.cluster_id and p.bin = f.prev_bin
    where flag_compare and not exists (select 1 from tier_item c where c.content_type = f.content_type and c.cluster_id = f.cluster_id
                                       and c.bin = f.bin and c.video_id = p.video_id)""")
sql_view("tier_pair", """
    select f.content_type, f.cluster_id, f.bin, prev_cluster_id, prev_bin, flag_same_cluster, flag_same_bin, flag_compare,
           coalesce(n, 0) as num_progression, num_cx, num_cy
    from tier_flag f left join (select content_type, cluster_id, bin, count(*) as n from tier_progression group by all) g
      on g.content_type = f.content_type and g.cluster_id = f.cluster_id and g.bin = f.bin
    where flag_compare is null or (flag_compare and num_cx > 100 and num_cy > 100)""")
sql_view("tier_source", """
    select content_type, cluster_id, bin, prev_bin, num_cx, num_cy, lag(bin) over (partition by content_type, cluster_id order by bin) as source_bin
    from tier_pair where flag_compare""")
sql_view("tier_sampled", """
    with q as (
        select content_type, cluster_id, bin, comparison_flow, video_id as query_video_id from (
            select s.content_type, s.cluster_id, s.bin, i.video_id,
                   'cluster_' || s.cluster_id || '->bin_' || coalesce(source_bin, 0) || '->bin_' || s.bin as comparison_flow,
                   row_number() over (partition by s.content_type, s.cluster_id, s.bin order by md5('tierq|' || i.video_id), i.video_id) as rn
            from tier_source s join tier_item i on i.content_type = s.content_type and i.cluster_id = s.cluster_id and i.bin = s.prev_bin)
        where rn <= 300),
    c as (
        select i.content_type, i.cluster_id, i.bin, i.video_id as candidate_video_id,
               row_number() over (partition by i.content_type, i.cluster_id, i.bin order by md5('tiert|' || i.video_id), i.video_id) as rn,
               count(*) over (partition by i.content_type, i.cluster_id, i.bin) as n
        from tier_source s join tier_item i on i.content_type = s.content_type and i.cluster_id = s.cluster_id and i.bin = s.bin)
    select q.content_type, q.cluster_id, q.bin, comparison_flow, query_video_id, candidate_video_id from q
    join c on c.content_type = q.content_type and c.cluster_id = q.cluster_id and c.bin = q.bin
    where (c.rn - 1 - ('0x' || substr(md5('tiers|' || query_video_id), 1, 7))::bigint % c.n + c.n) % c.n < 200""")
sql_view("tier_far", """
    select s.content_type, s.cluster_id, s.bin, comparison_flow, query_video_id, candidate_video_id,
           round(1 - list_cosine_similarity(q.avg_embedding, c.avg_embedding), 9) as distance
    from tier_sampled s join avg_vector q on q.video_id = query_video_id join avg_vector c on c.video_id = candidate_video_id
    where query_video_id <> candidate_video_id""")
sql_view("tier_distance", "select * from tier_far where distance < 0.336")
sql_view("tier_candidates", """
    select content_type, cluster_id, bin, query_video_id, comparison_flow, candidate_video_id, distance from (
        select *, row_number() over (partition by content_type, cluster_id, bin, query_video_id
                                     order by md5('tierk|' || query_video_id || '|' || candidate_video_id), candidate_video_id) as rn
        from (select *, percent_rank() over (partition by content_type, cluster_id, bin, query_video_id order by distance) as share
              from tier_distance) where share <= 0.15) where rn <= 30""")

sql_view("region_candidate", """
    select video_id, region, score, probability, case when probability >= 0.7 then true when probability < 0.4 then false end as nsfw_label
    from (select video_id, region, try_cast(within_region_popularity_score as double) as score from region_popularity)
    left join (select video_id, probability from item_nsfw) using (video_id) where score > 0""")
sql_view("popular_item", r"""
    select distinct case when coalesce(n.probability, 0.5) > 0.7 and i.is_nsfw then 'nsfw'
                         when coalesce(n.probability, 0.5) < 0.4 and not i.is_nsfw then 'clean' end as content_type,
           regexp_extract(uri, 'gs://items/([a-f0-9]{32})\.mp4', 1) as video_id, post_id, coalesce(n.probability, 0.5::double) as nsfw_probability,
           coalesce(n.is_nsfw, i.is_nsfw) as is_nsfw, nsfw_ec, nsfw_gore, 0.0::double as global_popularity_score
    from item_index i left join item_nsfw n on n.video_id = regexp_extract(uri, 'gs://items/([a-f0-9]{32})\.mp4', 1)
    where post_id is not null and length(post_id) > 5 and try_cast(post_id as bigint) is null
      and regexp_extract(uri, 'gs://items/([a-f0-9]{32})\.mp4', 1) <> ''""")
sql_view("popular_pool", """
    select *, row_number() over (partition by content_type order by md5('popular|' || video_id), video_id) as position
    from popular_item where content_type is not null qualify position <= 10000""")
sql_view("touched_later", """
    select distinct video_id from interaction where last_watched_timestamp >= timestamp '2002-01-20' - interval 90 days
    or last_liked_timestamp >= timestamp '2002-01-20' - interval 90 days or last_shared_timestamp >= timestamp '2002-01-20' - interval 90 days""")
sql_view("untouched_pool", r"""
    select case when is_flag then 'nsfw' else 'clean' end as content_type, video_id,
           case when probability >= 0.7 then true when probability < 0.4 then false end as is_nsfw, probability as nsfw_probability,
           row_number() over (partition by is_flag order by md5('untouched|' || video_id), video_id) as position
    from (select distinct n.video_id, n.probability, n.is_nsfw as is_flag from item_nsfw n
          where video_id in (select regexp_extract(uri, '([^/]+)\.mp4$', 1) from item_index) and video_id in (select video_id from item_unique)
            and video_id not in (select video_id from touched_later))
    qualify position <= 80000""")
content_view("region_pool", """
    select region, video_id, score, row_number() over (partition by region order by score desc, video_id desc) as position
    from region_candidate where nsfw_label = ('@' = 'nsfw') qualify position <= 225""")

content_view("content_interaction", "select * exclude (content_type) from split_interaction where content_type = '@'")
content_view("user_meta", """
    select user_id, coalesce(cluster_id, -1) as cluster_id, coalesce(total_seconds, -1) as total_seconds,
           cast(case when total_seconds is null then -1 when total_seconds <= percentile_25 then 0 when total_seconds <= percentile_50 then 1
                when total_seconds <= percentile_75 then 2 else 3 end as int) as bin
    from user_region left join (select s.*, percentile_25, percentile_50, percentile_75 from tier_seconds s
        join tier_bound b on b.content_type = s.content_type and b.cluster_id = s.cluster_id where s.content_type = '@') using (user_id)""")
content_view("query_item", """
    select user_id, query_video_id, pos, n, watch_percentage, importance, m.cluster_id, m.bin from (
        select user_id, video_id as query_video_id, mean_percentage_watched::double as watch_percentage,
               row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) - 1 as pos, count(*) over (partition by user_id) as n,
               0.8::double * (case when count(*) over (partition by user_id) > 1 then 1.0::double - (row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) - 1)
                     / count(*) over (partition by user_id) else 1.0::double end) + 0.2::double * mean_percentage_watched as importance
        from (select * from (select *, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as recency from content_interaction_@)
              where recency <= 100) where mean_percentage_watched >= 0.1) q
    join user_meta_@ m using (user_id) where m.cluster_id >= 0 and m.bin >= 0""")
sql_view("cluster_pool", """
    select distinct content_type, cluster_id, 'watch_time_quantile' as kind, candidate_video_id as video_id from tier_candidates
    union select distinct content_type, cluster_id, 'modified_iou', video_id_y from iou_candidates""")
content_view("shared_pool", """
    select 'cluster:' || cluster_id as pool_key, case when kind = 'watch_time_quantile' then 3 else 4 end as type_num, video_id from (
        select *, row_number() over (partition by cluster_id, kind order by md5('pool|' || kind || '|' || video_id), video_id) as rn
        from cluster_pool where content_type = '@') where rn <= 225
    union select 'region:' || region, 5, video_id from region_pool_@
    union select 'global', 6, video_id from popular_pool where content_type = '@' and position <= 225
    union select 'global', 6, video_id from untouched_pool where content_type = '@' and position <= 50""")
content_view("keyed_user", """
    select user_id, 'cluster:' || m.cluster_id as pool_key from user_meta_@ m where cluster_id >= 0 and bin >= 0
    union all select user_id, 'region:' || region from user_meta_@ m join user_region using (user_id) where cluster_id >= 0 and bin >= 0
    union all select user_id, 'global' from user_meta_@ m where cluster_id >= 0 and bin >= 0""")
content_view("user_pool", "select user_id, type_num, video_id from keyed_user_@ join shared_pool_@ using (pool_key)")
content_view("personal_row", """
    select user_id, q.query_video_id, 1 as type_num, candidate_video_id from query_item_@ q
    join tier_candidates c on c.content_type = '@' and c.cluster_id = q.cluster_id and c.bin = q.bin and c.query_video_id = q.query_video_id
    union select user_id, q.query_video_id, 2, video_id_y from query_item_@ q
    join iou_candidates c on c.content_type = '@' and c.cluster_id = q.cluster_id and c.video_id_x = q.query_video_id""")
content_view("needed_pair", """
    select distinct query_video_id, candidate_video_id from (
        select query_video_id, candidate_video_id from personal_row_@
        union all select query_video_id, video_id from (select distinct pool_key, query_video_id from query_item_@ join keyed_user_@ using (user_id)) join shared_pool_@ using (pool_key))
    where query_video_id <> candidate_video_id""")
content_view("pair_similarity", """
    select query_video_id, candidate_video_id, round(max(list_cosine_similarity(q.embedding, c.embedding)), 6) as similarity
    from needed_pair_@ join item_vector q on q.video_id = query_video_id join item_vector c on c.video_id = candidate_video_id
    group by query_video_id, candidate_video_id""")
content_view("reranked", """
    select user_id, query_video_id, type_num, candidate_video_id, similarity from (
        select user_id, query_video_id, type_num, candidate_video_id, similarity from personal_row_@ join pair_similarity_@ using (query_video_id, candidate_video_id)
        union all
        select q.user_id, q.query_video_id, type_num, candidate_video_id, similarity
        from query_item_@ q join user_pool_@ p on p.user_id = q.user_id
        join (select * from pair_similarity_@ where similarity >= 0.4) s on s.query_video_id = q.query_video_id and s.candidate_video_id = p.video_id) r
    where not exists (select 1 from query_item_@ o where o.user_id = r.user_id and o.query_video_id = r.candidate_video_id)""")


def _contributions(per_query: int, floor: float) -> str:
    return f"""
        select user_id, query_video_id, type_num, candidate_video_id, similarity, pos, place,
               round(importance * weight * similarity, 9) as score, type_num >= 3 as is_pool,
               pos * 10000 + type_num * 1000 + place as turn
        from (select *, case when type_num >= 3 then 0 else row_number() over (partition by user_id, query_video_id, type_num
                        order by similarity desc, candidate_video_id) end as place from reranked_@)
        join (select * from (values (1, 1.0::double), (2, 0.8::double), (3, 0.6::double), (4, 0.5::double), (5, 0.4::double), (6, 0.3::double)) k(type_num, weight)) using (type_num)
        join query_item_@ using (user_id, query_video_id)
        where similarity >= {floor} and (type_num >= 3 or place <= {per_query})"""


content_view("mixed", f"""
    select user_id, is_pool, candidate_video_id, score, position from (
        select *, row_number() over (partition by user_id, is_pool order by score desc, turn, candidate_video_id) as position from (
            select user_id, is_pool, candidate_video_id, case when is_pool then max(score) else arg_min(score, turn) end as score, min(turn) as turn
            from ({_contributions(15, 0.4)}) group by user_id, is_pool, candidate_video_id)) where position <= 225""")
sql_view("item_meta", r"""
    with one as (
        select video_id, arg_min(post_id, item_timestamp) as post_id, arg_min(coalesce(canister_id, 'default-canister'), item_timestamp) as canister_id,
               arg_min(publisher_user_id, item_timestamp) as publisher_user_id
        from (select nullif(regexp_extract(uri, '([^/]+)\.mp4$', 1), '') as video_id, * from item_index)
        where video_id is not null and post_id is not null and publisher_user_id is not null group by video_id)
    select o.video_id, case when m.post_id is null or m.canister_id is null then o.post_id else m.post_id end as post_id,
           case when m.post_id is null or m.canister_id is null then o.canister_id else m.canister_id end as canister_id, publisher_user_id,
           coalesce(probability, 0.0::double) as nsfw_probability, coalesce(total_count_loggedin, 0) as num_views_loggedin, coalesce(total_count_all, 0) as num_views_all
    from one o left join post_mapping m on m.old_canister_id = o.canister_id and m.old_post_id = o.post_id
    left join item_nsfw n on n.video_id = o.video_id left join view_counts v on v.item_id = o.video_id""")
sql_view("watched_pair", f"""
    select distinct user_id, video_id from interaction where last_watched_timestamp >= timestamp '{AS_OF}' - interval 60 days""")
sql_view("live_pair", "select distinct user_id, item_id as video_id from watch_event where event_id % 101 <> 0")
sql_view("reported_pair", """
    select distinct reportee_user_id as user_id, case when contains(uri, '.mp4') then split_part(list_last(string_split(uri, '/')), '.mp4', 1) else uri end as video_id
    from (select reportee_user_id, video_uri as uri from reports union all select reportee_user_id, parent_video_uri from reports)
    where uri is not null and reportee_user_id not like '%test%'""")
content_view("backup_row", """
    select user_id, video_id, source, row_number() over (partition by user_id order by source, rank) as position from (
        select user_id, video_id, 0 as source, position as rank from user_region join region_pool_@ using (region)
        union all
        select user_id, video_id, 1, position from user_region, popular_pool where content_type = '@' and position <= 225
           and not exists (select 1 from watched_pair w where w.user_id = user_region.user_id and w.video_id = popular_pool.video_id)
           and not exists (select 1 from reported_pair w where w.user_id = user_region.user_id and w.video_id = popular_pool.video_id)
        union all
        select user_id, video_id, 2, position from user_region, untouched_pool where content_type = '@' and position <= 50)""")


# ---- queries --------------------------------------------------------------------------------------

@query("split_interactions", "select user_id, video_id, cluster_id, mean_percentage_watched, probability, nsfw_label from split_interaction")
def split_interactions(t):
    return split(t).select("user_id", "video_id", "cluster_id", "mean_percentage_watched", "probability", "nsfw_label")


@query("iou_candidates", "select content_type, cluster_id, video_id_x, video_id_y, den, num, iou_modified from iou_candidates")
def iou_candidates(t):
    return iou(t)


@query("tier_pairs", """
    select content_type, cluster_id, bin, prev_cluster_id, prev_bin, flag_same_cluster, flag_same_bin, flag_compare, num_progression, num_cx, num_cy
    from tier_pair""")
def tier_pairs(t):
    return tier_pair_rows(t)


@query("tier_candidates", """
    select content_type, cluster_id, bin, query_video_id, comparison_flow, candidate_video_id, round(distance, 6) as distance from tier_candidates""")
def tier_candidates(t):
    return tier(t).withColumn("distance", F.round("distance", 6))


@query("region_candidates", "select video_id, region, score, probability, nsfw_label from region_candidate where nsfw_label is not null")
def region_candidates(t):
    return pools.region_candidates(t.region_popularity, t.item_nsfw).select("video_id", "region", "score", "probability", "nsfw_label")


@query("popular_pool", "select * from popular_pool where position <= 25")
def popular_pool(t):
    rows = pools.popular_pool(t.item_index, t.item_nsfw, "items", 25)
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("untouched_pool", "select * from untouched_pool where position <= 25")
def untouched_pool(t):
    rows = pools.untouched_pool(t.item_index, t.item_nsfw, t.item_unique, t.interaction, "2002-01-20 00:00:00", 25)
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("user_metadata", "select content_type, user_id, cluster_id, total_seconds::double as total_seconds, bin from user_meta")
def user_metadata(t):
    return of_both(lambda c: profile_of(t, c))


# candidates are compared by sums of their hashes, which need no list of them
@query("fetch_all_candidates", """
    select content_type, user_id, type_num, count(*) as candidates, cast(sum(('0x' || substr(md5(pair), 1, 12))::bigint) as bigint) as digest from (
        select content_type, user_id, type_num, query_video_id || '>' || candidate_video_id as pair from personal_row
        union all select content_type, user_id, type_num, '>' || video_id from user_pool) group by all""")
def fetch_all_candidates(t):
    def build(content):
        s = Served(t, content)
        return serve.fetch_all_candidates(s.queries, s.keys, s.tier, s.iou, s.pools, mark=F.conv(F.substring(F.md5(pair), 1, 12), 16, 10).cast("bigint"))

    pair = F.concat(F.coalesce("query_video_id", F.lit("")), F.lit(">"), F.col("candidate_video_id"))
    return of_both(build).groupBy("content_type", "user_id", "type_num").agg(F.count(F.lit(1)).alias("candidates"), F.sum("mark").alias("digest"))


@query("rerank", "select content_type, user_id, query_video_id, type_num, candidate_video_id, similarity from reranked")
def rerank(t):
    def build(content):
        s = Served(t, content)
        return serve.rerank(s.scored(), s.queries)

    return of_both(build)


@query("mix", "select content_type, user_id, is_pool, candidate_video_id, score, cast(position as int) as position from mixed")
def mix(t):
    def build(content):
        s = Served(t, content)
        return serve.mix(s.scored(), s.queries)

    return of_both(build)


content_view("mixed_sum", f"""
    select user_id, is_pool, candidate_video_id, score, source_count, position from (
        select *, row_number() over (partition by user_id, is_pool order by score desc, turn, candidate_video_id) as position from (
            select user_id, is_pool, candidate_video_id, round(sum(score), 9) as score, min(turn) as turn, count(*) as source_count
            from (select *, row_number() over (partition by user_id, candidate_video_id, is_pool order by turn) as k from ({_contributions(3, 0.5)}))
            where is_pool or k = 1 group by user_id, is_pool, candidate_video_id)) where position <= case when is_pool then 50 else 10 end""")


@query("mix_sum", "select content_type, user_id, is_pool, candidate_video_id, score, source_count, cast(position as int) as position from mixed_sum")
def mix_sum(t):
    def build(content):
        s = Served(t, content)
        return serve.mix_sum(s.scored(), s.queries)

    return of_both(build)


sql_view("newest_row", """
    select user_id, video_id, row_number() over (partition by user_id order by last_watched_timestamp desc, video_id) as position from interaction""")


def newest_rows(t):
    """All items of every user, newest first."""
    places = ranked(t.interaction.select("user_id", "video_id", "last_watched_timestamp"), ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")])
    return places.select("user_id", "video_id", F.col("rn").alias("position"))


# a request's own list: what the user liked
@query("exclude_items", """
    select user_id, video_id, position from newest_row n
    where not exists (select 1 from interaction i where i.user_id = n.user_id and i.video_id = n.video_id and liked)""")
def exclude_items(t):
    return serve.exclude_items(newest_rows(t), t.interaction.where("liked"))


@query("filter_watched", """
    select user_id, video_id, position from newest_row n
    where not exists (select 1 from watched_pair w where w.user_id = n.user_id and w.video_id = n.video_id)
      and not exists (select 1 from live_pair w where w.user_id = n.user_id and w.video_id = n.video_id)""")
def filter_watched(t):
    live = t.watch_event.where(rules.parse_event(F.col("event"))["video_id"].isNotNull()).select("user_id", F.col("item_id").alias("video_id")).distinct()
    return serve.filter_watched(newest_rows(t), live, pools.watched_items(t.interaction, AS_OF))


@query("filter_reported", """
    select user_id, video_id, position from newest_row n
    where not exists (select 1 from reported_pair w where w.user_id = n.user_id and w.video_id = n.video_id)""")
def filter_reported(t):
    return serve.exclude_items(newest_rows(t), pools.all_reported(t.reports))


@query("split_by_flag", """
    select user_id, video_id, position, exists (select 1 from watched_pair w where w.user_id = n.user_id and w.video_id = n.video_id) as seen from newest_row n""")
def split_by_flag(t):
    return serve.split_by_flag(newest_rows(t), pools.watched_items(t.interaction, AS_OF), "seen")


@query("filter_duplicates", "select user_id, video_id, position from newest_row where video_id in (select video_id from item_unique)")
def filter_duplicates(t):
    return serve.filter_duplicates(newest_rows(t), t.item_unique).select("user_id", "video_id", "position")


@query("fallback_recommendations", "select content_type, user_id, video_id, source, cast(position as int) as position from backup_row")
def fallback_recommendations(t):
    return of_both(lambda c: backup_of(t, c))


def backup_of(t: Tables, content: str, excluded: DataFrame | None = None, as_lists: bool = False) -> DataFrame:
    rows = serve.fallback_recommendations(
        t.user_region, region_rows(t, content), popular_rows(t, content), untouched_rows(t, content), pools.watched_items(t.interaction, AS_OF),
        pools.all_reported(t.reports), excluded, as_lists=as_lists,
    )
    return rows if as_lists else rows.select("user_id", "video_id", "source", "position")


# a request may name items to leave out of every source
@query("fallback_excluded", """
    select content_type, user_id, count(*) as items, md5(string_agg(video_id, ',' order by position)) as digest from backup_row b
    where not exists (select 1 from interaction i where i.user_id = b.user_id and i.video_id = b.video_id and liked) group by all""")
def fallback_excluded(t):
    lists = of_both(lambda c: backup_of(t, c, t.interaction.where("liked"), as_lists=True))
    listed = F.transform("items", lambda s: s["video_id"])
    return lists.select("content_type", "user_id", F.size("items").cast("bigint").alias("items"), F.md5(F.array_join(listed, ",")).alias("digest"))


def metadata_of(t: Tables, text_ids: bool = True) -> DataFrame:
    return serve.item_metadata(t.item_index, t.item_nsfw, serve.view_counts(t.view_event), t.post_mapping, text_ids)


@query("attach_metadata", """
    select user_id, position, video_id, post_id, canister_id, publisher_user_id, nsfw_probability, num_views_loggedin, num_views_all
    from newest_row join item_meta using (video_id)""")
def attach_metadata(t):
    return serve.attach_metadata(newest_rows(t), metadata_of(t)).select(
        "user_id", "position", "video_id", "post_id", "canister_id", "publisher_user_id", "nsfw_probability", "num_views_loggedin", "num_views_all"
    )


def catalogue_of(t: Tables, content: str) -> serve.Catalogue:
    tier_rows = tier_table(t).where(F.col("content_type") == content)
    iou_rows = iou_table(t).where(F.col("content_type") == content)
    rows = content_rows(t, content)
    live = lambda: t.watch_event.where(rules.parse_event(F.col("event"))["video_id"].isNotNull()).select("user_id", F.col("item_id").alias("video_id")).distinct()
    # what does not depend on the content type is stored once for both
    return serve.Catalogue(
        users=t.user_region, interactions=rows,
        bins=tiers.tier_bins(tiers.user_watch_time(rows, ["cluster_id"]), ["cluster_id"]),
        tier=tier_rows, iou=iou_rows, cluster_pool=pools.cluster_fallback_pool(tier_rows, iou_rows),
        region_pool=region_rows(t, content), popular=popular_rows(t, content), untouched=untouched_rows(t, content), item_vectors=item_vectors(t),
        watched=t.stage("watched_items", lambda: pools.watched_items(t.interaction, AS_OF)), live_watched=t.stage("live_items", live),
        reported=t.stage("all_reported", lambda: pools.all_reported(t.reports)), metadata=t.stage("item_metadata", lambda: metadata_of(t)),
    )


sql_view("unwanted_pair", """
    select user_id, video_id from watched_pair union select user_id, video_id from live_pair union select user_id, video_id from reported_pair""")
content_view("servable", f"""
    select user_id, video_id, origin, position from (
        select user_id, video_id, case when is_pool then 'pool' else 'personal' end as origin, k, k + case when is_pool then 225 else 0 end as position from (
            select *, row_number() over (partition by user_id, is_pool order by score desc, turn, video_id) as k from (
                select user_id, is_pool, candidate_video_id as video_id, case when is_pool then max(score) else arg_min(score, turn) end as score, min(turn) as turn
                from ({_contributions(15, 0.4)}) group by user_id, is_pool, candidate_video_id) s
            where video_id in (select video_id from item_meta)
              and not exists (select 1 from unwanted_pair w where w.user_id = s.user_id and w.video_id = s.video_id))) where k <= 225""")
content_view("chain_row", """
    select * from (select user_id, video_id, min(turn) as turn from (
        select user_id, video_id, position as turn from user_region join region_pool_@ using (region)
        union all select user_id, video_id, 1000 + position from user_region, popular_pool where content_type = '@' and position <= 225
        union all select user_id, video_id, 2000 + position from user_region, untouched_pool where content_type = '@' and position <= 50)
        group by user_id, video_id) c
    where video_id in (select video_id from item_meta)
      and not exists (select 1 from unwanted_pair w where w.user_id = c.user_id and w.video_id = c.video_id)""")
content_view("recommended", """
    with offered as (
        select user_id, video_id, origin, position from servable_@ union all select user_id, video_id, 'fallback', 10000 + turn from chain_row_@),
    once as (select user_id, video_id, arg_min(origin, position) as origin, min(position) as position from offered group by user_id, video_id)
    select user_id, cast(row_number() over (partition by user_id order by position, video_id) as int) as place, video_id, origin, post_id, canister_id,
           publisher_user_id, nsfw_probability, num_views_loggedin, num_views_all
    from once join item_meta using (video_id) qualify place <= 50""")


@query("recommend_all", "select * from recommended")
def recommend_all(t):
    return of_both(lambda c: serve.recommend_all(catalogue_of(t, c)))
