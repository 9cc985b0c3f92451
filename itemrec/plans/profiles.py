"""User vectors: average item vector, time-position vector and cluster shares."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from itemrec.functions import ids, rules, vectors
from itemrec.operators.ranking import paged_lists, top_n
from itemrec.runtime import broadcast_checked, store, stored_bytes

# Profile sizes.
MAX_RECENT = 100
MIN_ITEMS = 2
MIN_PERCENT = 25
TIME_BINS = 16
CLUSTERS = 10
ROPE_DIM = 16
ROPE_BASE = 10000.0


def keyed_vectors(item_index: DataFrame) -> DataFrame:
    """Item id with each of its vectors."""
    return (
        item_index.select(ids.item_id_strict(F.col("uri")).alias("video_id"), "embedding", "item_timestamp")
        .where(F.col("video_id").isNotNull() & F.col("embedding").isNotNull())
    )


def avg_embedding(item_index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Element-wise mean over an item's vectors, of all items or of those in ``wanted`` (video_id)."""
    rows = keyed_vectors(item_index)
    rows = rows if wanted is None else rows.join(wanted.select("video_id"), "video_id", "left_semi")
    return vectors.mean_vector(rows, ["video_id"], "embedding", "avg_embedding")


def avg_embedding_exploded(item_index: DataFrame) -> DataFrame:
    """The same by exploding every element; kept as the comparison form for tests and the bench."""
    elements = keyed_vectors(item_index).select("video_id", F.posexplode("embedding").alias("pos", "value"))
    means = elements.groupBy("video_id", "pos").agg(F.avg("value").alias("m"))
    lists = means.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("e"))
    return lists.select("video_id", F.transform("e", lambda s: s["m"]).alias("avg_embedding"))


def missing_embeddings(item_index: DataFrame, averages: DataFrame) -> DataFrame:
    """Ids in the index that have no average yet."""
    wanted = item_index.select(ids.item_id_strict(F.col("uri")).alias("video_id")).where("video_id is not null").distinct()
    return wanted.join(averages.select("video_id"), "video_id", "left_anti")


def avg_embedding_incremental(item_index: DataFrame, averages: DataFrame) -> DataFrame:
    """Averages for the missing ids only, to be appended."""
    vectors_of = keyed_vectors(item_index).join(averages.select("video_id"), "video_id", "left_anti")
    return vectors.mean_vector(vectors_of, ["video_id"], "embedding", "avg_embedding")


def first_embedding(item_index: DataFrame) -> DataFrame:
    """The earliest vector of each (uri, item). Vectors move once, by item, so that what is numbered by item afterwards stays where it is."""
    source = item_index.where("uri is not null and embedding is not null and item_timestamp is not null")
    placed = source.select("uri", ids.item_id_lenient(F.col("uri")).alias("video_id"), "embedding", "item_timestamp").repartition("video_id")
    first = F.min_by("embedding", F.struct("item_timestamp", F.xxhash64("embedding")))
    return placed.groupBy("uri", "video_id").agg(first.alias("embedding"))


#: Items whose vectors are broadcast at most: those with more than an even share of the rows.
HOT_ITEMS, HOT_BYTES = 2_000, 64 << 20


def attach_vectors(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``rows`` (video_id, ...) with each vector of their item; rows of items without one are left out.

    An item that many have watched would bring all of them, and its vector beside each, to one task. So the items with
    more than an even share of the rows, few by that, have their vectors broadcast after a look at their size, and
    their rows stay where they are. The other rows are joined while they are narrow.
    """
    rows = store(rows)
    known = embeddings.where(F.col("embedding").isNotNull()).select("video_id", "embedding")
    counts = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    even = F.lit(max(1, -(-rows.count() // HOT_ITEMS)))
    hot = store(known.join(counts.where(F.col("n") > even).select("video_id"), "video_id", "left_semi"))
    if stored_bytes(hot) > HOT_BYTES:
        return rows.join(known, "video_id")  # wider vectors than planned: adaptive execution splits the hot keys
    ids_of = F.broadcast(hot.select("video_id").distinct())
    return rows.join(F.broadcast(hot), "video_id").unionByName(rows.join(ids_of, "video_id", "left_anti").join(known, "video_id"))


def join_embeddings(interactions: DataFrame, embeddings: DataFrame, how: str = "inner") -> DataFrame:
    """Interactions beside their item's vectors; the left form differs only before rows without a vector are dropped."""
    picked = interactions.select("user_id", "video_id", "mean_percentage_watched", "last_watched_timestamp")
    return attach_vectors(picked, embeddings)


def users_with_min_items(df: DataFrame, minimum: int = MIN_ITEMS) -> DataFrame:
    enough = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(enough.select("user_id"), "user_id", "left_semi")


def recent_n_per_user(df: DataFrame, n: int = MAX_RECENT) -> DataFrame:
    return top_n(df, ["user_id"], [F.col("last_watched_timestamp").desc(), F.col("video_id")], n, "recency")


def min_watch(df: DataFrame, percent: float = MIN_PERCENT) -> DataFrame:
    return df.withColumn("percent", rules.watched_share(F.col("mean_percentage_watched"))).where(F.col("percent") > percent)


def numbered_vectors(embeddings: DataFrame) -> DataFrame:
    """Stored vectors by (video_id, nth): an item's several vectors are told apart by their number."""
    known = embeddings.where(F.col("video_id").isNotNull() & F.col("embedding").isNotNull()).select("video_id", "embedding")
    return store(known.withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy(F.xxhash64("embedding")))))


def _recent_watched(interactions: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that count, once for each of the item's vectors by its number ``nth``; no vector is moved here.

    A user with the minimum of items has as many among the newest, so that is looked up beside them.
    """
    counts = known.groupBy("video_id").agg(F.max("nth").alias("vectors"))
    narrow = interactions.where(F.col("user_id").isNotNull()).select("user_id", "video_id", "mean_percentage_watched", "last_watched_timestamp").join(counts, "video_id")
    recent = recent_n_per_user(narrow, max(MAX_RECENT, MIN_ITEMS)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    kept = min_watch(recent.where((F.col("_n") >= MIN_ITEMS) & (F.col("recency") <= MAX_RECENT)).drop("_n"))
    return kept.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("vectors")))).drop("vectors")


#: Bytes of sums that a task holds at a time, sums put out at a time, and blocks of users at most.
HELD_BYTES, SUMS_AT_ONCE, USER_BLOCKS = 512 << 20, 5_000, 32


def _vector_sums(batches: Iterator[pa.RecordBatch], held_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sums by user over rows that follow the vectors of their item; a user's sum may come in several parts.

    A row with a number asks for that vector of its item, any other for all of them. ``counted`` is how many rows of
    the user have a vector, or the minimum of items where that is known already; rows without a weight only count.
    """
    codes: dict[str, int] = {}
    sums, seen, weighed = np.zeros((0, 0)), np.zeros(0, int), np.zeros(0, bool)
    last, key_before = None, None  # vectors of the item that the last batch ended with

    def held() -> Iterator[pa.RecordBatch]:
        users, width = list(codes), sums.shape[1]
        for i in range(0, len(users), SUMS_AT_ONCE):
            end = min(i + SUMS_AT_ONCE, len(users))
            given = weighed[i:end]
            ends = np.concatenate([[0], np.cumsum(given)]).astype(np.int32) * width
            lists = pa.ListArray.from_arrays(ends, pa.array(sums[i:end][given].ravel()), mask=pa.array(~given))
            yield pa.RecordBatch.from_arrays([pa.array(users[i:end], pa.string()), pa.array(seen[i:end]), lists], ["user_id", "counted", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, vector = batch.column("key"), batch.column("embedding")
        changed = np.ones(batch.num_rows, bool)
        changed[0] = key_before is None or key[0] != key_before
        changed[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        item, key_before = np.cumsum(changed) - changed[0], key[len(key) - 1]
        given = vector.is_valid().to_numpy(zero_copy_only=False)
        found = vector.filter(vector.is_valid())
        matrix = found.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(found), -1) if len(found) else np.zeros((0, 0))
        number = np.bincount(item[given], minlength=item[-1] + 1)
        if last is not None and not changed[0]:  # the first rows belong to the item of the last batch
            matrix, number[0] = np.vstack([last, matrix]) if len(matrix) else last, number[0] + len(last)
        start = np.cumsum(number) - number
        last = matrix[start[-1] :] if number[-1] else None
        asks = np.nonzero(~given & (number[item] > 0))[0]
        if not len(asks):
            continue
        nth = batch.column("nth").fill_null(0).to_numpy(zero_copy_only=False)[asks]
        weight, weighs = batch.column("weight").fill_null(0.0).to_numpy(zero_copy_only=False)[asks], batch.column("weight").is_valid().to_numpy(zero_copy_only=False)[asks]
        coded = batch.column("user_id").take(pa.array(asks)).dictionary_encode()
        names, row = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if codes and (len(codes) + len(names)) * 8 * matrix.shape[1] > held_bytes:
            yield from held()
            sums[: len(codes)], seen[: len(codes)], weighed[: len(codes)] = 0.0, 0, False
            codes.clear()
        at = np.array([codes.setdefault(u, len(codes)) for u in names])
        if len(codes) > len(sums):  # as many as may be held: memory is taken when it is written to
            most = max(len(codes), held_bytes // (8 * matrix.shape[1]))
            grown = np.zeros((most, matrix.shape[1])), np.zeros(most, int), np.zeros(most, bool)
            for new, old in zip(grown, (sums, seen, weighed)):
                new[: len(old)] = old if len(old) else new[:0]
            sums, seen, weighed = grown
        np.add.at(seen, at[row], np.where(nth > 0, MIN_ITEMS, 1))
        of = item[asks]
        many = np.where(nth > 0, 1, number[of]) * weighs
        each = np.repeat(np.arange(len(asks)), many)
        place = (start[of] + np.maximum(nth - 1, 0))[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(row[each], kind="stable")
        each, place = each[order], place[order]
        if len(each):
            first = np.nonzero(np.diff(row[each], prepend=-1))[0]
            to = at[row[each[first]]]
            sums[to] += np.add.reduceat(matrix[place] * weight[each, None], first, axis=0)
            weighed[to] = True
    if codes:
        yield from held()


def _blocks(users: int, known: DataFrame, tasks: int) -> tuple[int, int]:
    """Blocks of users and of items: together one for each task, as many users to a block as a task holds sums of, and otherwise so that
    vectors, sent to each block of users, and sums, sent from each block of items, are about as many bytes."""
    vectors_n, width = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    even = math.sqrt(tasks * 2 * users / max(1, vectors_n))
    by_user = math.ceil(min(USER_BLOCKS, max(1, even, users * 8 * width / HELD_BYTES)))
    return by_user, max(1, math.ceil(tasks / by_user))


def _weighted_mean(rows: DataFrame, known: DataFrame, weight: Column, users: int, light: DataFrame | None = None) -> DataFrame:
    """Unit vector along the weighted sum; a mean has the same direction.

    Users and items are cut into blocks. A vector goes once to each block of users, a row without one to the cell of its
    user and item, and what a cell adds up for a user is one sum. So vectors move as often as there are blocks of users, and
    sums as often as there are blocks of items, however many rows there are. ``rows`` have (video_id, nth) of a vector; rows of ``light``
    (user_id, video_id, weight) are all that their users have: the cells find out which of their items have vectors, and how many.
    """
    by_user, by_item = _blocks(users, known, rows.sparkSession.sparkContext.defaultParallelism)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind = known.schema["embedding"].dataType
    columns = ["cell", "key", "nth", "user_id", "weight", "embedding"]

    def asking(df: DataFrame, nth: Column, weight: Column) -> DataFrame:
        cell = block("user_id", by_user) * by_item + block("video_id", by_item)
        return df.select(cell.alias("cell"), ids.packed(F.col("video_id")).alias("key"), nth.cast("int").alias("nth"), "user_id", weight.cast("double").alias("weight"), F.lit(None).cast(kind).alias("embedding"))

    asks = asking(rows, F.col("nth"), weight)
    asks = asks if light is None else asks.unionByName(asking(light, F.lit(None), F.col("weight")))
    gives = known.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(by_user - 1)), lambda u: u * by_item + block("video_id", by_item))).alias("cell"),
        ids.packed(F.col("video_id")).alias("key"), F.col("nth").cast("int").alias("nth"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("double").alias("weight"), "embedding",
    )
    placed = asks.select(*columns).unionByName(gives.select(*columns)).repartitionById(by_user * by_item, F.col("cell"))
    placed = placed.sortWithinPartitions("key", F.col("user_id").isNotNull(), "nth")
    held = HELD_BYTES
    parts = placed.select(*columns[1:]).mapInArrow(lambda batches: _vector_sums(batches, held), "user_id string, counted bigint, part array<double>")
    lists = parts.repartition("user_id").groupBy("user_id").agg(F.sum("counted").alias("counted"), F.collect_list("part").alias("parts"))
    whole = F.reduce(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    means = lists.where((F.col("counted") >= MIN_ITEMS) & (F.size("parts") > 0)).select("user_id", whole.alias("m"))
    return means.select("user_id", vectors.l2_normalise(F.col("m")).alias("embedding"))


def _mean_of_recent(interactions: DataFrame, embeddings: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean over the newest rows that pass. ``interactions`` are read twice or more.

    A user with no more rows than the newest that count needs no order: such rows go straight to the cells. Only those of
    other users, few unless users watch a lot, are looked up among the items and put in order before.
    """
    known = numbered_vectors(embeddings)
    rows = interactions.where("user_id is not null and video_id is not null").select("user_id", "video_id", "mean_percentage_watched", "last_watched_timestamp")
    seen = Observation()
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.count(F.lit(1)).alias("users"))
    heavy = broadcast_checked(counts.where(F.col("n") > max(MAX_RECENT, MIN_ITEMS)).select("user_id"))
    percent = rules.watched_share(F.col("mean_percentage_watched"))
    light = rows.join(heavy, "user_id", "left_anti").select("user_id", "video_id", F.when(percent > MIN_PERCENT, weight).alias("weight"))
    return _weighted_mean(_recent_watched(rows.join(heavy, "user_id", "left_semi"), known), known, weight, seen.get["users"], light)


def user_avg_embedding(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    return _mean_of_recent(interactions, embeddings, F.lit(1.0))


def user_avg_embedding_watch_weighted(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    return _mean_of_recent(interactions, embeddings, F.col("mean_percentage_watched"))


def user_avg_embedding_decay(interactions: DataFrame, embeddings: DataFrame, decay: float = 10.0) -> DataFrame:
    """Weight sqrt(exp(-pos/decay) * percent), pos counted from the newest row that passed the watch filter."""
    known = numbered_vectors(embeddings)
    rows = top_n(
        _recent_watched(interactions, known), ["user_id"],
        [F.col("last_watched_timestamp").desc(), F.col("video_id"), F.col("nth")], MAX_RECENT, "pos",
    )
    users = interactions.agg(F.approx_count_distinct("user_id")).first()[0]
    clipped = F.least(F.greatest("percent", F.lit(0.0)), F.lit(100.0))
    return _weighted_mean(rows, known, F.sqrt(F.exp(-(F.col("pos") - 1) / decay) * clipped), users)


def collect_engagement(interactions: DataFrame, page_size: int = 1000) -> DataFrame:
    """Each user's history in time order as consecutive lists of structs."""
    record = F.struct(
        "video_id", "last_watched_timestamp", "mean_percentage_watched", "liked", "shared", "cluster_label"
    )
    rows = interactions.withColumn("_record", record)
    return paged_lists(rows, ["user_id"], [F.col("last_watched_timestamp"), F.col("video_id")], F.col("_record"), page_size)


def cluster_counts(interactions: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """Counts per cluster 0..k-1 as columns c0..; conditional sums, one pass."""
    label = F.col("cluster_label")
    inside = interactions.where(label.isNotNull() & (label >= 0) & (label < clusters))
    return inside.groupBy("user_id").agg(*[F.count_if(label == i).alias(f"c{i}") for i in range(clusters)])


def _count_array(clusters: int) -> Column:
    return F.array(*[F.col(f"c{i}").cast("double") for i in range(clusters)])


def cluster_distribution(interactions: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """Shares per cluster scaled to unit length; the norm removes the total."""
    return cluster_counts(interactions, clusters).select(
        "user_id", vectors.l2_normalise(_count_array(clusters)).alias("distribution")
    )


def cluster_distribution_share(interactions: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    counts = cluster_counts(interactions, clusters).withColumn("v", _count_array(clusters))
    total = vectors.array_sum(F.col("v"))
    return counts.withColumn("t", total).select("user_id", F.transform("v", lambda x: x / F.col("t")).alias("distribution"))


def timestamp_bounds(interactions: DataFrame) -> DataFrame:
    return interactions.agg(
        F.min("last_watched_timestamp").alias("min_timestamp"), F.max("last_watched_timestamp").alias("max_timestamp")
    )


def time_bin(stamp: Column, low: Column, high: Column, bins: int = TIME_BINS) -> Column:
    day = F.lit(86400.0)
    width = (F.unix_seconds(high) - F.unix_seconds(low)) / day / bins
    days = (F.unix_seconds(stamp) - F.unix_seconds(low)) / day
    return F.least(F.floor(F.when(width > 0, days / width).otherwise(F.lit(0.0))), F.lit(bins - 1)).cast("int")


def temporal_counts(interactions: DataFrame, bins: int = TIME_BINS) -> DataFrame:
    """(user, cluster, time bin, n) between the table's own first and last time."""
    limits = timestamp_bounds(interactions).select(F.struct("min_timestamp", "max_timestamp")).scalar()
    low, high = limits["min_timestamp"], limits["max_timestamp"]
    placed = interactions.where(F.col("cluster_label").isNotNull()).withColumn(
        "time_bin", time_bin(F.col("last_watched_timestamp"), low, high, bins)
    )
    return placed.groupBy("user_id", "cluster_label", "time_bin").agg(F.count(F.lit(1)).alias("n"))


def temporal_distribution(interactions: DataFrame, clusters: int = CLUSTERS, bins: int = TIME_BINS) -> DataFrame:
    """user -> cluster -> fixed-length counts; at most clusters x bins numbers per user."""
    counts = temporal_counts(interactions, bins)
    rows = counts.groupBy("user_id", "cluster_label").agg(
        F.array(*[F.sum(F.when(F.col("time_bin") == b, F.col("n")).otherwise(0)) for b in range(bins)]).alias("v")
    )
    found = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster_label", "v"))).alias("m"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), bins)
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(clusters - 1)), lambda c: F.struct(c.alias("key"), F.coalesce(F.try_element_at("m", c), zero).alias("value"))
    )
    return found.select("user_id", F.map_from_entries(pairs).alias("temporal"))


def rope_basis(spark, clusters: int = CLUSTERS, bins: int = TIME_BINS, dim: int = ROPE_DIM) -> DataFrame:
    """The rotated unit pattern of every (cluster, time bin); clusters x bins rows by rule."""
    grid = spark.range(clusters * bins).select(
        F.floor(F.col("id") / bins).cast("int").alias("cluster_label"), (F.col("id") % bins).cast("int").alias("time_bin")
    )
    wave = lambda i: F.sin(F.col("cluster_label") * (i + 1) / dim) * 0.5 + 0.5
    base = grid.withColumn("b", vectors.l2_normalise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: wave(i))))

    def turned(i: int) -> Column:
        even = i - i % 2
        angle = F.col("time_bin") * F.lit(ROPE_BASE ** (-even / dim))
        x, y = F.col("b")[even], F.col("b")[even + 1]
        return x * F.cos(angle) - y * F.sin(angle) if i % 2 == 0 else x * F.sin(angle) + y * F.cos(angle)

    return base.select("cluster_label", "time_bin", *[turned(i).alias(f"r{i}") for i in range(dim)])


def rope_by_cluster(counts: DataFrame, dim: int = ROPE_DIM) -> DataFrame:
    """Unit time-position vector per (user, cluster) as a weighted sum over the basis.

    A user's counts, at most one for each cluster and bin, come together first: what is added up from then on stays in its task.
    """
    basis = F.broadcast(rope_basis(counts.sparkSession, dim=dim))  # CLUSTERS x TIME_BINS rows by construction
    sums = (
        counts.repartition("user_id").join(basis, ["cluster_label", "time_bin"])
        .groupBy("user_id", "cluster_label")
        .agg(F.array(*[F.sum(F.col("n") * F.col(f"r{i}")) for i in range(dim)]).alias("v"))
    )
    return sums.select("user_id", "cluster_label", vectors.l2_normalise(F.col("v")).alias("rope"))


def temporal_mean(by_cluster: DataFrame, dim: int = ROPE_DIM, clusters: int = CLUSTERS) -> DataFrame:
    sums = by_cluster.groupBy("user_id").agg(F.array(*[F.sum(F.col("rope")[i]) / clusters for i in range(dim)]).alias("v"))
    return sums.select("user_id", vectors.l2_normalise(F.col("v")).alias("temporal"))


def temporal_concat(by_cluster: DataFrame, dim: int = ROPE_DIM, clusters: int = CLUSTERS) -> DataFrame:
    """All clusters' vectors end to end, zeros where a cluster is absent."""
    found = by_cluster.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster_label", "rope"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0), dim)
    joined = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(clusters - 1)), lambda c: F.coalesce(F.try_element_at("m", c), zero)))
    return found.select("user_id", joined.alias("v")).select("user_id", vectors.l2_normalise(F.col("v")).alias("temporal"))


def rope_position(counts: DataFrame, bins: int = TIME_BINS, dim: int = ROPE_DIM, share: bool = False) -> DataFrame:
    """sin/cos of the bin's position at falling frequencies, weighted by count and scaled to unit length.

    ``share`` weights by the bin's part of the user's total; scaling makes both forms equal.
    """
    per_bin = counts.groupBy("user_id", "time_bin").agg(F.sum("n").alias("n"))

    def part(i: int) -> Column:
        theta = F.col("time_bin") / bins / F.lit(ROPE_BASE ** (2 * (i // 2) / dim))
        return F.sum(F.col("n") * (F.sin(theta) if i % 2 == 0 else F.cos(theta)))

    sums = per_bin.groupBy("user_id").agg(F.array(*[part(i) for i in range(dim)]).alias("v"), F.sum("n").alias("t"))
    weighted = F.transform("v", lambda x: x / F.col("t")) if share else F.col("v")
    return sums.select("user_id", weighted.alias("v")).select("user_id", vectors.l2_normalise(F.col("v")).alias("temporal"))


def join_three_vectors(average: DataFrame, temporal: DataFrame, distribution: DataFrame) -> DataFrame:
    return average.join(temporal, "user_id").join(distribution, "user_id")


def time_parts(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Temporal and distribution vectors. ``interactions`` are read three times."""
    rows = interactions.select("user_id", "cluster_label", "last_watched_timestamp")
    return temporal_mean(rope_by_cluster(temporal_counts(rows))), cluster_distribution(rows)


def user_vector(interactions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Average, temporal and distribution parts end to end."""
    parts = join_three_vectors(user_avg_embedding(interactions, embeddings), *time_parts(interactions))
    merged = vectors.concat_vectors(F.col("embedding"), F.col("temporal"), F.col("distribution"))
    return parts.select("user_id", merged.alias("user_embedding"))
