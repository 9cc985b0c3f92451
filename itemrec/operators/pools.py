"""Pools used when a user has no personal candidates: regional, popular, untouched, per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.functions import ids, rules
from itemrec.operators.ranking import ranked, top_n, with_percent_rank
from itemrec.runtime import materialize

# Sizes of the stored pools and of one request.
POPULAR_SIZE = 10_000
UNTOUCHED_SIZE = 80_000
UNTOUCHED_PICK = 50
REGION_DEFAULT, REGION_CEILING = 50, 1000
IDLE_DAYS = 90
HISTORY_DAYS = 60
HISTORY_SIZE = 50_000
REPORTED_SIZE = 10_000


def positive_scores(popularity: DataFrame) -> DataFrame:
    score = F.col("within_region_popularity_score").try_cast("double")
    return popularity.select("video_id", "region", score.alias("score")).where(F.col("score") > 0)


def region_labelled(popularity: DataFrame, nsfw: DataFrame) -> DataFrame:
    return (
        positive_scores(popularity).join(nsfw.select("video_id", "probability"), "video_id", "left")
        .withColumn("nsfw_label", rules.nsfw_region_label(F.col("probability")))
    )


def region_candidates(popularity: DataFrame, nsfw: DataFrame) -> DataFrame:
    return region_labelled(popularity, nsfw).where(F.col("nsfw_label").isNotNull())


def region_topk(candidates: DataFrame, k: int = REGION_DEFAULT, low: float | None = None, high: float | None = None,
                keys: tuple[str, ...] = ("nsfw_label", "region")) -> DataFrame:
    """The ``k`` best items of each region; more than the service ever answers with is refused, not cut."""
    if k > REGION_CEILING:
        raise ValueError(f"at most {REGION_CEILING} items of a region")
    rows = candidates if low is None else candidates.where(F.col("score") >= low)
    rows = rows if high is None else rows.where(F.col("score") <= high)
    return top_n(rows, list(keys), [F.col("score").desc(), F.col("video_id").desc()], k, "position")


def region_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("nsfw_label", "region").agg(
        F.count(F.lit(1)).alias("items"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def score_ladder(candidates: DataFrame) -> DataFrame:
    """0-based place of every item in its region, best first."""
    places = ranked(candidates, ["nsfw_label", "region"], [F.col("score").desc(), F.col("video_id").desc()])
    return places.withColumn("place", F.col("rn") - 1).drop("rn", "group_n")


def region_label_counts(popularity: DataFrame, nsfw: DataFrame) -> DataFrame:
    label = F.col("nsfw_label")
    return region_labelled(popularity, nsfw).groupBy("region").agg(
        F.count_if(label).alias("nsfw_count"), F.count_if(~label).alias("clean_count"),
        F.count_if(label.isNull()).alias("undetermined_count"), F.count(F.lit(1)).alias("total_count"),
    )


def region_examples(popularity: DataFrame, nsfw: DataFrame, examples: int = 5, regions: int = 20, wanted: bool = False) -> DataFrame:
    """Largest regions with the number of items of the wanted label and their likeliest-nsfw items; ``max_by`` style top lists, never the region's whole list."""
    rows = region_labelled(popularity, nsfw)
    counts = rows.groupBy("region").agg(
        F.count("video_id").alias("num_items"), F.count_if(F.col("nsfw_label").isNull()).alias("num_null_label"),
        F.count_if(F.col("nsfw_label").isNotNull()).alias("num_nonnull_label"),
        F.count_if(F.col("nsfw_label") == wanted).alias("num_matching_label"),
    ).orderBy(F.col("num_items").desc(), "region").limit(regions)
    best = top_n(rows, ["region"], [F.col("probability").desc_nulls_last(), F.col("video_id")], examples)
    lists = best.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rn", "video_id", "probability"))).alias("e"))
    return counts.join(lists, "region").withColumn(
        "example_videos", F.transform("e", lambda s: F.struct(s["video_id"].alias("video_id"), s["probability"].alias("probability")))
    ).drop("e")


def popular_items(item_index: DataFrame, nsfw: DataFrame, bucket: str) -> DataFrame:
    """Distinct items that may serve a content type, with metadata and opaque post ids."""
    index = item_index.where(rules.is_opaque_post_id(F.col("post_id"))).select(
        ids.item_id_hex32(F.col("uri"), bucket).alias("video_id"), "post_id",
        F.col("is_nsfw").alias("index_nsfw"), "nsfw_ec", "nsfw_gore",
    ).where(F.col("video_id").isNotNull())
    joined = index.join(nsfw.select("video_id", "probability", F.col("is_nsfw").alias("agg_nsfw")), "video_id", "left")
    return joined.select(
        rules.pool_content_type(F.col("probability"), F.col("index_nsfw")).alias("content_type"), "video_id", "post_id",
        F.coalesce("probability", F.lit(rules.MISSING_PROBABILITY)).alias("nsfw_probability"),
        F.coalesce("agg_nsfw", "index_nsfw").alias("is_nsfw"), "nsfw_ec", "nsfw_gore",
        F.lit(0.0).alias("global_popularity_score"),
    ).where(F.col("content_type").isNotNull()).distinct()


def shuffle_sample(pool: DataFrame, size: int, seed: str, keys: tuple[str, ...] = ("content_type",)) -> DataFrame:
    """First ``size`` of a reproducible shuffle, with their place in it; a content type is sorted by many tasks."""
    order = [ids.hash_order(seed, F.col("video_id")), F.col("video_id")]
    places = ranked(pool, list(keys), order, "position").where(F.col("position") <= size)
    return places.withColumn("position", F.col("position").cast("int")).drop("group_n")


def popular_pool(item_index: DataFrame, nsfw: DataFrame, bucket: str, size: int = POPULAR_SIZE) -> DataFrame:
    return shuffle_sample(popular_items(item_index, nsfw, bucket), size, "popular")


def popular_percentile_pool(scored: DataFrame, share: float = 0.3, keys: tuple[str, ...] = ("content_type",)) -> DataFrame:
    """Items within the top ``share`` by percent rank of popularity (content_type, video_id, score)."""
    ranks = with_percent_rank(scored, list(keys), "score", [F.col("video_id")], "percentile", descending=True)
    return ranks.where(F.col("percentile") <= share).drop("rn", "group_n")


def touched_items(interactions: DataFrame, as_of: str, days: int = IDLE_DAYS) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    recent = (
        (F.col("last_watched_timestamp") >= since) | (F.col("last_liked_timestamp") >= since)
        | (F.col("last_shared_timestamp") >= since)
    )
    return interactions.where(recent).select("video_id").distinct()


def untouched_items(item_index: DataFrame, nsfw: DataFrame, unique: DataFrame, interactions: DataFrame, as_of: str) -> DataFrame:
    """Unique, labelled items nobody watched, liked or shared lately.

    The content filter is on the stored flag while the label column comes from the probability.
    """
    items = item_index.select(ids.item_id_strict(F.col("uri")).alias("video_id")).where("video_id is not null").distinct()
    labelled = items.join(nsfw, "video_id").where(F.col("probability").isNotNull() & F.col("is_nsfw").isNotNull())
    kept = labelled.join(unique.select("video_id"), "video_id", "left_semi").join(
        touched_items(interactions, as_of), "video_id", "left_anti"
    )
    return kept.select(
        rules.content_type(F.col("is_nsfw")).alias("content_type"), "video_id",
        rules.nsfw_region_label(F.col("probability")).alias("is_nsfw"), F.col("probability").alias("nsfw_probability"),
    )


def untouched_pool(item_index, nsfw, unique, interactions, as_of: str, size: int = UNTOUCHED_SIZE) -> DataFrame:
    return shuffle_sample(untouched_items(item_index, nsfw, unique, interactions, as_of), size, "untouched")


def pool_rotation(users: DataFrame, pool: DataFrame, k: int, seed: str, wrap: bool = True) -> DataFrame:
    """``k`` consecutive pool places per user from a start drawn from the user's hash; the whole pool when it is no larger.

    With ``wrap`` any start is allowed; without it the start leaves room for ``k`` places. ``pool`` has content_type,
    video_id and position; users are joined on the place, never multiplied by the pool.
    """
    sizes = pool.groupBy("content_type").agg(F.max("position").alias("_n"))
    asked = users.join(F.broadcast(sizes), "content_type")  # one row per content type
    starts = F.col("_n") if wrap else F.greatest(F.col("_n") - k + 1, F.lit(1))
    asked = asked.withColumn("_start", ids.hash_number(seed, F.col("user_id")) % starts).withColumn(
        "rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n"))))
    )
    asked = asked.withColumn("position", (F.when(F.col("_n") <= k, 0).otherwise(F.col("_start")) + F.col("rank") - 1) % F.col("_n") + 1)
    return asked.join(pool.select("content_type", "position", "video_id"), ["content_type", "position"]).drop("_n", "_start", "position")


def pool_concat(*parts: DataFrame, key: str = "user_id") -> DataFrame:
    """Parts (``key``, video_id, rank) one after the other, the source's number leading the order.

    Shared pools are concatenated by the key that users share them under, not once for each user.
    """
    out = None
    for number, part in enumerate(parts):
        tagged = part.select(key, "video_id", F.lit(number).alias("source"), F.col("rank").cast("bigint").alias("rank"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def cluster_fallback_pool(tier: DataFrame, iou: DataFrame) -> DataFrame:
    """Every candidate of each cluster by kind, one row each."""
    a = tier.select("content_type", "cluster_id", F.lit("watch_time_quantile").alias("kind"), F.col("candidate_video_id").alias("video_id"))
    b = iou.select("content_type", "cluster_id", F.lit("modified_iou").alias("kind"), F.col("video_id_y").alias("video_id"))
    return a.unionByName(b).distinct()


def lookback(interactions: DataFrame, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return interactions.where(
        (F.col("last_watched_timestamp") >= since) & F.col("user_id").isNotNull() & F.col("video_id").isNotNull()
    )


def watched_items(interactions: DataFrame, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Every item a user watched inside the lookback: what exclusions read."""
    return lookback(interactions, as_of, days).select("user_id", "video_id").distinct()


def user_history(interactions: DataFrame, as_of: str, days: int = HISTORY_DAYS, size: int = HISTORY_SIZE, recency: bool = False) -> DataFrame:
    """Items per user inside the lookback as the cache stores them; the cap goes by item id unless ``recency``."""
    rows = lookback(interactions, as_of, days).groupBy("user_id", "video_id").agg(F.max("last_watched_timestamp").alias("t"))
    order = [F.col("t").desc(), F.col("video_id")] if recency else [F.col("video_id")]
    return top_n(rows, ["user_id"], order, size).select("user_id", "video_id")


def all_reported(reports: DataFrame) -> DataFrame:
    """Distinct reported items and their parents per user, test users and missing ids left out: what exclusions read."""
    real = reports.where(~F.col("reportee_user_id").like("%test%"))
    both = real.select(
        F.col("reportee_user_id").alias("user_id"), F.explode(F.array("video_uri", "parent_video_uri")).alias("uri")
    )
    return both.select("user_id", ids.item_id_passthrough(F.col("uri")).alias("video_id")).where("video_id is not null").distinct()


def reported_items(reports: DataFrame, size: int = REPORTED_SIZE) -> DataFrame:
    """Reported items per user as the cache stores them, capped by item id."""
    return top_n(all_reported(reports), ["user_id"], [F.col("video_id")], size).select("user_id", "video_id")
