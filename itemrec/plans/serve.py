"""Recommendations for all users as one plan: fetch, score, mix, filter, describe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.functions import ids, rules
from itemrec.operators.pools import UNTOUCHED_PICK
from itemrec.operators.ranking import top_n
from itemrec.operators.similarity import pair_similarity, pool_similarity
from itemrec.operators.tiers import user_watch_time
from itemrec.runtime import broadcast_checked, materialize, store

# Candidate kinds with their weights, and request settings.
KINDS = {
    1: ("watch_time_quantile", 1.0),
    2: ("modified_iou", 0.8),
    3: ("fallback_watch_time_quantile", 0.6),
    4: ("fallback_modified_iou", 0.5),
    5: ("fallback_safety_location", 0.4),
    6: ("fallback_safety_global", 0.3),
}
POOL_KINDS = [n for n, (name, _) in KINDS.items() if "fallback" in name]
TOP_K = POOL_TOP_K = POOL_SAMPLE = 225
QUERY_THRESHOLD = 0.1
MIN_SIMILARITY = 0.4
RECENCY_WEIGHT, WATCH_WEIGHT = 0.8, 0.2
PER_QUERY = 15
RESULTS = 50
#: Words of 64 bits in a user's exclusion sketch, and bits set for each item.
SKETCH_WORDS, SKETCH_HASHES = 64, 3


# ---- user side -------------------------------------------------------------------------------

def filter_watch_range(history: DataFrame, threshold: float = QUERY_THRESHOLD) -> DataFrame:
    """Rows whose percent is a number of at least ``threshold``; anything else is skipped."""
    percent = F.col("mean_percentage_watched").cast("string").try_cast("double")
    return history.withColumn("watch_percentage", percent).where(F.col("watch_percentage") >= threshold)


def watch_time_of(stamp: Column) -> Column:
    """Missing or unreadable times count as 1970."""
    return F.coalesce(F.try_to_timestamp(stamp.cast("string")), F.timestamp_seconds(F.lit(0)))


def query_items(history: DataFrame, threshold: float = QUERY_THRESHOLD) -> DataFrame:
    """A user's query items newest first with their importance; one row per item upstream."""
    rows = filter_watch_range(history, threshold).withColumn("_t", watch_time_of(F.col("last_watched_timestamp")))
    order = Window.partitionBy("user_id").orderBy(F.col("_t").desc(), "video_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    placed = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("n", n)
    return placed.select(
        "user_id", F.col("video_id").alias("query_video_id"), "pos", "n", "watch_percentage",
        importance(F.col("pos"), F.col("n"), F.col("watch_percentage")).alias("importance"),
    )


def importance(pos: Column, n: Column, percent: Column) -> Column:
    recency = F.when(n > 1, F.lit(1.0) - pos / n).otherwise(F.lit(1.0))
    return F.lit(RECENCY_WEIGHT) * recency + F.lit(WATCH_WEIGHT) * percent


def newest_history(interactions: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` items per user; the bound every later per-user step relies on."""
    return top_n(interactions, ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")], n, "recency")


def user_metadata(users: DataFrame, interactions: DataFrame, bins: DataFrame) -> DataFrame:
    """user -> cluster, seconds and tier; -1 where there is none. ``interactions`` hold one content type."""
    seconds = user_watch_time(interactions, ["cluster_id"])
    known = seconds.join(broadcast_checked(bins), "cluster_id", "left").select(
        "user_id", "cluster_id", "total_seconds",
        rules.tier_of(*[F.col(c) for c in ("total_seconds", "percentile_25", "percentile_50", "percentile_75")]).alias("bin"),
    )
    return users.select("user_id").join(known, "user_id", "left").select(
        "user_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("cluster_id", "total_seconds", "bin")]
    )


# ---- candidates ------------------------------------------------------------------------------

def personal_candidates(queries: DataFrame, tier: DataFrame, iou: DataFrame) -> DataFrame:
    """(user, query, kind, candidate) from the two item-to-item tables; ``queries`` carry cluster and bin."""
    q = queries.select("user_id", "cluster_id", "bin", "query_video_id")
    a = q.join(tier.select("cluster_id", "bin", "query_video_id", "candidate_video_id"), ["cluster_id", "bin", "query_video_id"])
    b = q.join(
        iou.select("cluster_id", F.col("video_id_x").alias("query_video_id"), F.col("video_id_y").alias("candidate_video_id")),
        ["cluster_id", "query_video_id"],
    )
    pick = lambda df, kind: df.select("user_id", "query_video_id", F.lit(kind).alias("type_num"), "candidate_video_id")
    return pick(a, 1).unionByName(pick(b, 2)).distinct()


def lookup_lists(queries: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Stored candidate lists by key; a missing key gives an empty list."""
    empty = F.expr("cast(array() as array<string>)")
    return queries.join(lists, keys, "left").withColumn("candidates", F.coalesce("candidates", empty))


def sample_cluster_pool(pool: DataFrame, size: int = POOL_SAMPLE, seed: str = "pool") -> DataFrame:
    """Up to ``size`` random items per cluster and kind, as rows keyed for scoring."""
    rows = top_n(
        pool, ["cluster_id", "kind"],
        [ids.hash_order(seed, F.col("kind"), F.col("video_id")), F.col("video_id")], size,
    )
    kind = F.when(F.col("kind") == "watch_time_quantile", 3).otherwise(4)
    return rows.select(F.concat(F.lit("cluster:"), F.col("cluster_id")).alias("pool_key"), kind.alias("type_num"), "video_id")


def shared_pools(cluster_pool: DataFrame, region_pool: DataFrame, global_pool: DataFrame) -> DataFrame:
    """The pools every user of a cluster, region or content type shares: (pool_key, type_num, video_id)."""
    regional = region_pool.select(F.concat(F.lit("region:"), F.col("region")).alias("pool_key"), F.lit(5).alias("type_num"), "video_id")
    worldwide = global_pool.select(F.lit("global").alias("pool_key"), F.lit(6).alias("type_num"), "video_id")
    return sample_cluster_pool(cluster_pool).unionByName(regional).unionByName(worldwide).distinct()


def user_pool_keys(users: DataFrame) -> DataFrame:
    """``users``: user_id, cluster_id, region."""
    keys = F.array(
        F.concat(F.lit("cluster:"), F.col("cluster_id")), F.concat(F.lit("region:"), F.col("region")), F.lit("global")
    )
    return users.select("user_id", F.explode(keys).alias("pool_key")).where("pool_key is not null")


def fetch_all_candidates(queries: DataFrame, keys: DataFrame, tier: DataFrame, iou: DataFrame, pools: DataFrame, **marks: Column) -> DataFrame:
    """Personal rows per query, and pool rows per user with no query.

    ``marks`` are more columns made of query_video_id, type_num and candidate_video_id: once for an entry of a pool, and not again for
    each user of the pool.
    """
    columns = ["query_video_id", "type_num", "candidate_video_id"]
    entries = pools.select("pool_key", F.lit(None).cast("string").alias("query_video_id"), "type_num", F.col("video_id").alias("candidate_video_id"))
    entries = entries.select("pool_key", *columns, *[c.alias(n) for n, c in marks.items()])
    shared = keys.join(broadcast_checked(entries), "pool_key").select("user_id", *columns, *marks)
    personal = personal_candidates(queries, tier, iou)
    return personal.select("user_id", *columns, *[c.alias(n) for n, c in marks.items()]).unionByName(shared)


def pool_lists(pools: DataFrame) -> DataFrame:
    """Each shared pool as one list per kind; pools are sampled, so lists have a fixed bound."""
    return pools.groupBy("pool_key", "type_num").agg(F.array_sort(F.collect_list("video_id")).alias("candidates"))


def expand_pool_to_queries(pools: DataFrame, keys: DataFrame, queries: DataFrame, **marks: Column) -> DataFrame:
    """Every pool list of a user beside each of the user's (at most 100) query items.

    The list is attached whole, so rows grow with queries and kinds, not with pool entries. ``marks`` are more columns
    made of the list's candidates, once for a list and not for each row that has it.
    """
    asked = queries.select("user_id", "query_video_id").join(keys, "user_id")
    lists = broadcast_checked(pool_lists(pools).select("*", *[c.alias(n) for n, c in marks.items()]))
    return asked.join(lists, "pool_key").select("user_id", "query_video_id", "type_num", "candidates", *marks)


# ---- scoring ---------------------------------------------------------------------------------

def drop_own_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    own = queries.select("user_id", F.col("query_video_id").alias("candidate_video_id")).distinct()
    return rows.join(own, ["user_id", "candidate_video_id"], "left_anti")


@dataclass
class Scored:
    """Similarities of all kinds; those with pools are kept once for all users that share them.

    ``near`` has, for each pool and query item, the pool's items that are at least ``floor`` alike: a
    list no longer than the pool, which is sampled.
    """

    personal: DataFrame  # user_id, query_video_id, type_num, candidate_video_id, similarity, listed
    asked: DataFrame     # user_id, query_video_id, pos, importance, pool_key
    near: DataFrame      # pool_key, query_video_id, candidates: array of (type_num, candidate_video_id, similarity)
    floor: float

    def pooled(self) -> DataFrame:
        """A row per user, query item and pool item; what follows should add them up by user before any shuffle."""
        return self.asked.join(self.near, ["pool_key", "query_video_id"]).select(
            "user_id", "query_video_id", "pos", "importance", F.inline("candidates")
        )


def score_candidates(queries: DataFrame, keys: DataFrame, tier: DataFrame, iou: DataFrame, pools: DataFrame, item_vectors: DataFrame,
                     floor: float = MIN_SIMILARITY, listed: DataFrame | None = None) -> Scored:
    """Similarity is a fact about two items, so it is computed once per item pair: listed pairs for
    the personal kinds, groups of pools and the distinct query items that ask for one of them for the pools.

    With ``listed`` (video_id), other items can't be served: they leave the pools, and personal rows are marked,
    since those count among the best of their query item.
    """
    personal = personal_candidates(queries, tier, iou)
    known = pair_similarity(personal, item_vectors)
    if listed is not None:
        known = known.join(listed.select(F.col("video_id").alias("candidate_video_id"), F.lit(True).alias("listed")), "candidate_video_id", "left")
    known = known.withColumn("listed", F.coalesce("listed", F.lit(False)) if listed is not None else F.lit(True))
    scored = personal.join(known, ["query_video_id", "candidate_video_id"])
    asked = queries.select("user_id", "query_video_id", "pos", "importance").join(keys, "user_id")
    pools = pools if listed is None else pools.join(listed.select("video_id"), "video_id", "left_semi")
    pairs = pool_similarity(asked, pools, item_vectors, floor).join(pools.withColumnRenamed("video_id", "candidate_video_id"), ["pool_key", "candidate_video_id"])
    lists = pairs.groupBy("pool_key", "query_video_id").agg(F.collect_list(F.struct("type_num", "candidate_video_id", "similarity")).alias("candidates"))
    columns = ["user_id", "query_video_id", "type_num", "candidate_video_id", "similarity", "listed"]
    # Broadcast if small, so that the join leaves a user's rows in their task; else adaptive execution splits popular query items.
    return Scored(scored.select(*columns), asked, broadcast_checked(lists, 64 << 20), floor)


def rerank(scored: Scored, queries: DataFrame) -> DataFrame:
    """(user, query, kind, candidate, similarity) written out for all kinds."""
    columns = ["user_id", "query_video_id", "type_num", "candidate_video_id", "similarity"]
    return drop_own_queries(scored.personal.select(*columns).unionByName(scored.pooled().select(*columns)), queries)


def _weight() -> Column:
    out = None
    for number, (_, weight) in KINDS.items():
        out = F.when(F.col("type_num") == number, weight) if out is None else out.when(F.col("type_num") == number, weight)
    return out


def _contributions(source: DataFrame | Scored, queries: DataFrame, per_query: int, floor: float) -> DataFrame:
    """Rows that count, with their score and processing order; ``source`` is rows of ``rerank`` or what they come from.

    Personal kinds keep their best ``per_query`` per (user, query, kind) before the floor applies.
    """
    q = queries.select("user_id", "query_video_id", "pos", "importance")
    if isinstance(source, Scored):
        if floor < source.floor:
            raise ValueError(f"pairs below {source.floor} were not kept")
        personal, pooled = drop_own_queries(source.personal, queries), source.pooled()
    else:
        is_pool = F.col("type_num").isin(POOL_KINDS)
        personal, pooled = source.where(~is_pool), source.where(is_pool).join(q, ["user_id", "query_video_id"])
    order = [F.col("similarity").desc(), F.col("candidate_video_id")]
    best = top_n(personal, ["user_id", "query_video_id", "type_num"], order, per_query, "rank").join(q, ["user_id", "query_video_id"])
    best = best.where("listed").drop("listed") if "listed" in best.columns else best
    rows = best.unionByName(pooled.withColumn("rank", F.lit(0))).where(F.col("similarity") >= floor)
    return rows.select(
        "user_id", "query_video_id", "type_num", "candidate_video_id", "similarity",
        F.round(F.col("importance") * _weight() * F.col("similarity"), 9).alias("score"),
        F.struct("pos", "type_num", "rank").alias("turn"), F.col("type_num").isin(POOL_KINDS).alias("is_pool"),
    )


def _without_own(rows: DataFrame, source: DataFrame | Scored, queries: DataFrame) -> DataFrame:
    """Pool items that are a user's own query items go after the sum, when there are fewest rows."""
    return drop_own_queries(rows, queries) if isinstance(source, Scored) else rows


def _top(scored: DataFrame, top_k: int, pool_k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("turn"), F.col("candidate_video_id")]
    placed = top_n(scored, ["user_id", "is_pool"], order, max(top_k, pool_k), "position")
    return placed.where(F.col("position") <= F.when(F.col("is_pool"), pool_k).otherwise(top_k))


# ---- exclusions ------------------------------------------------------------------------------

def _sketch_places(video: Column) -> list[Column]:
    """The bits of an item in a sketch: as many slices of its hash as there are hashes."""
    width = (64 * SKETCH_WORDS).bit_length() - 1
    return [F.shiftrightunsigned(F.xxhash64(video), width * i).bitwiseAND(64 * SKETCH_WORDS - 1) for i in range(SKETCH_HASHES)]


def exclusion_sketches(pairs: DataFrame) -> DataFrame:
    """user -> Bloom filter of the user's excluded items, of one size whatever their number."""
    bits = pairs.select("user_id", F.explode(F.array(*_sketch_places(F.col("video_id")))).alias("place"))
    words = bits.groupBy("user_id", F.shiftright("place", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    held = words.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("sketch"))


def may_be_excluded(sketch: Column, video: Column) -> Column:
    """False: surely not. True: the item, or others of the user that set the same bits, is excluded."""
    hits = []
    for place in _sketch_places(video):
        word = F.get(sketch, F.shiftright(place, 6).cast("int"))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))
        hits.append(word.bitwiseAND(mask) != 0)
    return sketch.isNotNull() & reduce(Column.__and__, hits)


@dataclass
class Exclusions:
    """Items that users must not get: exact pairs, and a sketch of each user's to tell which rows need looking up."""

    pairs: DataFrame  # user_id, video_id

    @classmethod
    def of(cls, *parts: DataFrame | None, among: DataFrame | None = None) -> Exclusions:
        """With ``among`` (video_id) only pairs of these items are kept: all that can be offered, few beside what users have watched."""
        pairs = reduce(DataFrame.unionByName, [p.select("user_id", "video_id") for p in parts if p is not None])
        if among is not None:
            pairs = pairs.join(broadcast_checked(among.select("video_id").distinct(), 32 << 20), "video_id", "left_semi").select("user_id", "video_id")
        return cls(store(pairs.distinct()))

    @cached_property
    def sketches(self) -> DataFrame:
        """user_id, sketch."""
        return store(exclusion_sketches(self.pairs))

    def first(self, rows: DataFrame, group: list[str], order: list[Column], places: Column) -> DataFrame:
        """The first ``places`` rows of each group that aren't excluded, as position; ``rows`` have user_id and video_id.

        Rows that the sketch clears are counted as they come, and what has enough of them before it is cut
        at once, in the task that holds the user. Only rows in doubt that are left are looked up.
        """
        flagged = rows.join(self.sketches, "user_id", "left").withColumn("doubt", may_be_excluded(F.col("sketch"), F.col("video_id"))).drop("sketch")
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        cleared = F.coalesce(F.sum(F.when(F.col("doubt"), 0).otherwise(1)).over(before), F.lit(0))
        left = store(flagged.withColumn("ahead", cleared).where(F.col("ahead") < places).drop("ahead"))
        kept = left.where(~F.col("doubt")).unionByName(exclude_items(left.where("doubt"), self.pairs).select(*left.columns)).drop("doubt")
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return kept.withColumn("position", place).where(F.col("position") <= places)


def mix(source: DataFrame | Scored, queries: DataFrame, top_k: int = TOP_K, pool_k: int = POOL_TOP_K,
        per_query: int = PER_QUERY, floor: float = MIN_SIMILARITY, exclusions: Exclusions | None = None) -> DataFrame:
    """Score = importance x kind weight x similarity. Personal: first occurrence wins; pools: best score wins.

    Excluded items take no place. They and a user's own query items go in the sum itself, as rows that mark an item, and what is left
    of a user comes together in one task, which the steps after this one need not change.
    """
    turn = F.col("turn.pos").cast("bigint") * (1 << 28) + F.col("turn.type_num") * (1 << 24) + F.col("turn.rank")  # one number, in the order of the three
    rows = _contributions(source, queries, per_query, floor).withColumn("turn", turn)
    columns = ["user_id", "is_pool", "candidate_video_id", "score", "position"]
    if exclusions is None:
        best = rows.groupBy("user_id", "is_pool", "candidate_video_id").agg(
            F.min_by("score", "turn").alias("first_score"), F.max("score").alias("best_score"), F.min("turn").alias("turn")
        )
        best = _without_own(best, source, queries)
        scored = best.withColumn("score", F.when(F.col("is_pool"), F.col("best_score")).otherwise(F.col("first_score")))
        return _top(scored, top_k, pool_k).select(*columns)
    unwanted = exclusions.pairs.select("user_id", F.col("video_id").alias("candidate_video_id"))
    if isinstance(source, Scored):
        unwanted = unwanted.unionByName(queries.select("user_id", F.col("query_video_id").alias("candidate_video_id")))
    offered = rows.select("user_id", "candidate_video_id", "is_pool", "score", "turn", F.lit(0).alias("unwanted"))
    both = offered.unionByName(unwanted.withColumn("unwanted", F.lit(1)), allowMissingColumns=True)
    pooled, personal = F.col("is_pool"), ~F.col("is_pool")
    best = both.groupBy("user_id", "candidate_video_id").agg(
        F.max("unwanted").alias("unwanted"),
        F.min_by(F.when(personal, F.col("score")), F.when(personal, F.col("turn"))).alias("first_score"), F.min(F.when(personal, F.col("turn"))).alias("first_turn"),
        F.max(F.when(pooled, F.col("score"))).alias("best_score"), F.min(F.when(pooled, F.col("turn"))).alias("best_turn"),
    ).where("unwanted = 0")
    side = lambda is_pool, name: F.struct(F.lit(is_pool).alias("is_pool"), F.col(f"{name}_score").alias("score"), F.col(f"{name}_turn").alias("turn"))
    scored = best.select("user_id", "candidate_video_id", F.inline(F.array(side(False, "first"), side(True, "best")))).where("turn is not null")
    return _top(scored.repartition("user_id"), top_k, pool_k).select(*columns)


def mix_sum(source: DataFrame | Scored, queries: DataFrame, top_k: int = 10, pool_k: int = 50,
            per_query: int = 3, floor: float = 0.5, with_sources: bool = False) -> DataFrame:
    """Older rule: pool scores add up over queries and kinds; sources (at most queries x kinds) on request."""
    rows = _contributions(source, queries, per_query, floor)
    first = Window.partitionBy("user_id", "candidate_video_id").orderBy("turn")
    once = rows.where(~F.col("is_pool")).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    rows = once.unionByName(rows.where("is_pool"))
    extra = [F.array_sort(F.collect_list(F.struct("turn", "query_video_id", "type_num", "similarity", "score"))).alias("sources")]
    summed = rows.groupBy("user_id", "is_pool", "candidate_video_id").agg(
        F.round(F.sum("score"), 9).alias("score"), F.min("turn").alias("turn"), F.count(F.lit(1)).alias("source_count"),
        *(extra if with_sources else []),
    )
    summed = _without_own(summed, source, queries)
    keep = ["user_id", "is_pool", "candidate_video_id", "score", "source_count", "position"]
    return _top(summed, top_k, pool_k).select(*keep, *(["sources"] if with_sources else []))


# ---- filters ---------------------------------------------------------------------------------

def exclude_items(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop (user_id, video_id) pairs of ``excluded``; positions keep the order."""
    return rows.join(excluded.select("user_id", "video_id"), ["user_id", "video_id"], "left_anti")


def filter_watched(rows: DataFrame, live: DataFrame, stored: DataFrame) -> DataFrame:
    return exclude_items(exclude_items(rows, live), stored)


def split_by_flag(rows: DataFrame, marked: DataFrame, flag: str) -> DataFrame:
    known = marked.select("user_id", "video_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(known, ["user_id", "video_id"], "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def filter_duplicates(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """Only items of the unique set; an absent set leaves nothing."""
    return rows.join(unique.select("video_id"), "video_id", "left_semi")


def dedup_preserve_order(rows: DataFrame, order: str = "position") -> DataFrame:
    """One row per (user, item) at its first place."""
    others = [c for c in rows.columns if c not in ("user_id", "video_id", order)]
    kept = rows.groupBy("user_id", "video_id").agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others]
    )
    return kept.select(*rows.columns)


def final_trim(rows: DataFrame, results: int = RESULTS) -> DataFrame:
    return top_n(rows, ["user_id"], [F.col("position"), F.col("video_id")], results, "place")


# ---- metadata --------------------------------------------------------------------------------

def item_metadata(item_index: DataFrame, nsfw: DataFrame, views: DataFrame, mapping: DataFrame, text_ids: bool = True) -> DataFrame:
    """One row per item: current canister and post, publisher, probability, counters.

    Rows without item, post or publisher are dropped, a blank canister gets the default,
    and the pair is replaced by its mapping where the mapping is complete.
    """
    index = item_index.select(
        ids.item_id_strict(F.col("uri")).alias("video_id"), "post_id", "canister_id", "publisher_user_id", "item_timestamp"
    ).dropna(subset=["video_id", "post_id", "publisher_user_id"])
    if not text_ids:
        index = index.where(rules.is_uint64(F.col("post_id")))
    one = index.groupBy("video_id").agg(
        *[F.min_by(c, "item_timestamp").alias(c) for c in ("post_id", "canister_id", "publisher_user_id")]
    ).withColumn("canister_id", rules.default_canister(F.col("canister_id")))
    current = apply_post_mapping(one, mapping)
    described = current.join(nsfw.select("video_id", "probability"), "video_id", "left").join(
        views.withColumnRenamed("item_id", "video_id"), "video_id", "left"
    )
    return described.select(
        "video_id", "post_id", "canister_id", "publisher_user_id",
        F.coalesce("probability", F.lit(0.0)).alias("nsfw_probability"),
        F.coalesce("total_count_loggedin", F.lit(0)).alias("num_views_loggedin"),
        F.coalesce("total_count_all", F.lit(0)).alias("num_views_all"),
    ).where(F.trim("canister_id") != "")


def apply_post_mapping(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Current (canister, post) pair where both parts are mapped, the old pair otherwise."""
    full = mapping.dropna(subset=["canister_id", "post_id"]).select(
        F.col("old_canister_id").alias("canister_id"), F.col("old_post_id").alias("post_id"),
        F.col("canister_id").alias("_c"), F.col("post_id").alias("_p"),
    )
    return (
        rows.join(full, ["canister_id", "post_id"], "left")
        .withColumn("canister_id", F.coalesce("_c", "canister_id")).withColumn("post_id", F.coalesce("_p", "post_id"))
        .drop("_c", "_p").select(*rows.columns)
    )


def attach_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Inner join: items without metadata drop out, positions keep the order."""
    return rows.join(metadata, "video_id")


def view_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id").agg(
        F.count_if(F.col("logged_in")).alias("total_count_loggedin"), F.count(F.lit(1)).alias("total_count_all")
    )


# ---- whole jobs ------------------------------------------------------------------------------

#: Users whose lists a task writes out.
USERS_PER_TASK = 5_000


def user_tasks(users: DataFrame) -> int:
    """Tasks for steps that make many rows of a user: their input is too small to tell how many there should be."""
    return max(users.sparkSession.sparkContext.defaultParallelism, -(-users.count() // USERS_PER_TASK))


def fallback_recommendations(users: DataFrame, region_pool: DataFrame, popular: DataFrame, untouched: DataFrame,
                             watched: DataFrame, reported: DataFrame, excluded: DataFrame | None = None,
                             popular_k: int = TOP_K, untouched_k: int = UNTOUCHED_PICK, as_lists: bool = False) -> DataFrame:
    """Region list, then filtered popular items, then untouched ones: (user_id, video_id, source, position).

    ``users`` carry region; pools hold one content type with ``position``. Popular and
    untouched picks are shared by all users of a run. ``as_lists`` gives (user_id, items), an array of (source, rank, video_id).

    The lists of regions have a fixed bound and are one value that all tasks read. Of what is excluded only items of the pools
    matter, few for a user; they are put beside the user, and rows of users and items are made last and not shuffled.
    """
    entry = F.struct(F.col("source"), F.col("position").cast("int").alias("rank"), F.col("video_id"))
    everywhere = store(
        popular.where(F.col("position") <= popular_k).select("video_id", F.lit(1).alias("source"), "position")
        .unionByName(untouched.where(F.col("position") <= untouched_k).select("video_id", F.lit(2).alias("source"), "position"))
    )
    regional = store(region_pool.where("region is not null").select("region", "video_id", F.lit(0).alias("source"), "position"))
    offered = regional.select("video_id", "source").unionByName(everywhere.select("video_id", "source")).distinct()
    hits = lambda pairs, items: pairs.select("user_id", "video_id").join(broadcast_checked(items), "video_id").select("user_id", F.struct("source", "video_id").alias("pair"))
    pairs = hits(watched.select("user_id", "video_id").unionByName(reported.select("user_id", "video_id")), offered.where("source = 1"))
    pairs = pairs if excluded is None else pairs.unionByName(hits(excluded, offered))
    dropped = pairs.groupBy("user_id").agg(F.collect_set("pair").alias("dropped"))

    tasks = user_tasks(users)
    once = users.select("user_id", "region").groupBy("user_id").agg(F.collect_list("region").alias("regions"), F.count(F.lit(1)).cast("int").alias("n"))
    by_region = regional.groupBy("region").agg(F.array_sort(F.collect_list(entry)).alias("own")).agg(F.map_from_entries(F.collect_list(F.struct("region", "own")))).scalar()
    shared = everywhere.agg(F.array_sort(F.collect_list(entry))).scalar()
    known = once.join(dropped, "user_id", "left").repartition(tasks, "user_id").withColumn("by_region", by_region).withColumn("shared", shared)
    own = F.flatten(F.filter(F.transform("regions", lambda r: F.try_element_at("by_region", r)), lambda x: x.isNotNull()))
    # a user who comes several times has the lists of all those rows in one order
    items = F.when(F.col("n") == 1, F.concat(own, "shared")).otherwise(F.array_sort(F.concat(own, F.flatten(F.array_repeat("shared", F.col("n"))))))
    kept = F.filter("items", lambda x: ~F.array_contains("dropped", F.struct(x["source"].alias("source"), x["video_id"].alias("video_id"))))
    lists = known.withColumn("items", items).select("user_id", F.when(F.col("dropped").isNull(), F.col("items")).otherwise(kept).alias("items"))
    if as_lists:
        return lists.where(F.size("items") > 0)
    return lists.select("user_id", F.posexplode("items").alias("at", "item")).select("user_id", "item.video_id", "item.source", (F.col("at") + 1).alias("position"))


def fallback_chains(region_pool: DataFrame, popular: DataFrame, untouched: DataFrame, listed: DataFrame,
                    popular_k: int = TOP_K, untouched_k: int = UNTOUCHED_PICK) -> DataFrame:
    """region -> its items, then popular, then untouched ones, each once, as one list; a null region has those of all.

    Every part has a fixed length, so a list does too.
    """
    everywhere = popular.where(F.col("position") <= popular_k).select("video_id", F.lit(1).alias("source"), "position").unionByName(
        untouched.where(F.col("position") <= untouched_k).select("video_id", F.lit(2).alias("source"), "position")
    ).withColumn("pool_key", F.lit("global"))
    regions = region_pool.select("region").distinct().unionByName(region_pool.sparkSession.createDataFrame([(None,)], "region string"))
    shared = regions.withColumn("pool_key", F.lit("global")).join(everywhere, "pool_key").select("region", "video_id", "source", "position")
    own = region_pool.select("region", "video_id", F.lit(0).alias("source"), "position")
    once = own.unionByName(shared).join(listed.select("video_id"), "video_id", "left_semi").groupBy("region", "video_id").agg(F.min(F.struct("source", "position")).alias("turn"))
    return once.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "video_id"))), lambda s: s["video_id"]).alias("chain"))


def refill(short: DataFrame, chains: DataFrame, exclusions: Exclusions, tasks: int) -> DataFrame:
    """(user_id, video_id, position, places): for users with ``places`` left, that many of the chain of their region.

    ``short``: user_id, region, places, taken (what the user gets already, at most a page). What a user must not get of the
    items of chains is put beside the user and taken off the chain, so only items that are given become rows.
    """
    lists = broadcast_checked(chains)
    items = lists.select(F.explode("chain").alias("video_id")).distinct()
    dropped = exclusions.pairs.join(broadcast_checked(items), "video_id", "left_semi").groupBy("user_id").agg(F.collect_list("video_id").alias("dropped"))
    own = lists.select(F.col("region").alias("chain_region"), "chain")
    rest = lists.where("region is null").select(F.lit("global").alias("pool_key"), F.col("chain").alias("rest"))
    known = short.join(dropped, "user_id", "left").repartition(tasks, "user_id").join(own, F.col("region") == F.col("chain_region"), "left").withColumn("pool_key", F.lit("global"))
    known = known.join(F.broadcast(rest), "pool_key", "left").withColumn("chain", F.coalesce("chain", "rest"))
    none = F.expr("cast(array() as array<string>)")
    given = F.slice(F.array_except("chain", F.concat(F.coalesce("taken", none), F.coalesce("dropped", none))), F.lit(1), F.col("places"))
    placed = F.transform(given, lambda v: F.struct(F.array_position("chain", v).alias("turn"), v.alias("video_id")))
    offered = known.select("user_id", "places", F.inline(placed))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("turn"))
    return offered.withColumn("position", place).where(F.col("position") <= F.col("places")).select("user_id", "video_id", "position", "places")


@dataclass
class Catalogue:
    """Inputs of ``recommend_all`` for one content type."""

    users: DataFrame          # user_id, region
    interactions: DataFrame   # labelled interactions of the content type, with cluster_id
    bins: DataFrame           # tier bounds per cluster_id
    tier: DataFrame           # tier candidates
    iou: DataFrame            # shared-user candidates
    cluster_pool: DataFrame   # cluster_id, kind, video_id
    region_pool: DataFrame    # region, video_id, position
    popular: DataFrame        # video_id, position
    untouched: DataFrame      # video_id, position
    item_vectors: DataFrame   # video_id, embedding
    watched: DataFrame        # user_id, video_id
    live_watched: DataFrame   # user_id, video_id
    reported: DataFrame       # user_id, video_id
    metadata: DataFrame       # item_metadata


def recommend_all(c: Catalogue, results: int = RESULTS, excluded: DataFrame | None = None) -> DataFrame:
    """Ranked, filtered and described recommendations of every user: a full page wherever there are items for one.

    Watched, reported and excluded items, and items without metadata, take no place at any stage. Personal items
    come first, then pool items; the places that are left go to the fallback chain of the user's region.
    """
    metadata = store(c.metadata)
    chains = store(fallback_chains(c.region_pool, c.popular, c.untouched, metadata))
    profile = materialize(user_metadata(c.users, c.interactions, c.bins).join(c.users, "user_id"))
    served = profile.where((F.col("cluster_id") >= 0) & (F.col("bin") >= 0))
    history = newest_history(c.interactions)
    queries = materialize(query_items(history).join(served.select("user_id", "cluster_id", "bin"), "user_id"))
    pools = materialize(shared_pools(
        c.cluster_pool, c.region_pool, c.popular.where(F.col("position") <= POOL_SAMPLE)
        .select("video_id").unionByName(c.untouched.where(F.col("position") <= UNTOUCHED_PICK).select("video_id")),
    ))
    shared = pools.select("video_id").unionByName(chains.select(F.explode("chain").alias("video_id"))).distinct()
    own = c.tier.select(F.col("candidate_video_id").alias("video_id")).unionByName(c.iou.select(F.col("video_id_y").alias("video_id")))
    exclusions = Exclusions.of(c.watched, c.live_watched, c.reported, excluded, among=shared.unionByName(own))
    scored = score_candidates(queries, user_pool_keys(served), c.tier, c.iou, pools, c.item_vectors, listed=metadata)
    mixed = mix(scored, queries, exclusions=exclusions)
    offered = mixed.select(
        "user_id", F.col("candidate_video_id").alias("video_id"), (F.col("position") + F.when(F.col("is_pool"), TOP_K).otherwise(0)).alias("position")
    )
    page = final_trim(dedup_preserve_order(offered), results)
    origin = F.when(F.col("position") > TOP_K, "pool").otherwise("personal")  # personal items have the places up to TOP_K
    main = store(page.groupBy("user_id").agg(F.collect_list(F.struct("place", "video_id", origin.alias("origin"))).alias("page")))
    filled = main.select("user_id", F.size("page").alias("n"), F.when(F.size("page") < results, F.transform("page", lambda x: x["video_id"])).alias("taken"))
    short = c.users.join(filled, "user_id", "left").withColumn("places", F.lit(results) - F.coalesce("n", F.lit(0))).where("places > 0")
    backup = refill(short.select("user_id", "region", "places", "taken"), chains, exclusions, user_tasks(c.users))
    rest = backup.select("user_id", (F.lit(results) - F.col("places") + F.col("position")).alias("place"), "video_id", F.lit("fallback").alias("origin"))
    rows = main.select("user_id", F.inline("page"))
    # items of pools and chains are few for any number of users: what is known of them is broadcast, and their rows stay where they are
    common = broadcast_checked(metadata.join(shared, "video_id", "left_semi"))
    found = attach_metadata(rows.where("origin = 'personal'"), metadata).unionByName(
        attach_metadata(rows.where("origin = 'pool'").unionByName(rest), common)
    )
    return found.select(
        "user_id", "place", "video_id", "origin", "post_id", "canister_id", "publisher_user_id", "nsfw_probability",
        "num_views_loggedin", "num_views_all",
    )
