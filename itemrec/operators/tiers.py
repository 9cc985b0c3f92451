"""Watch-time tiers and what users of the next tier watch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemrec.functions import ids, vectors
from itemrec.operators.ranking import discrete_percentiles, ntile_from, ranked, top_n
from itemrec.runtime import broadcast_checked, materialize, store

SECONDS_PER_ITEM = 60
GROUP = ["content_type", "cluster_id"]


def user_watch_time(interactions: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Approximate seconds per user and cluster; rounded so ties do not depend on summation order."""
    return interactions.groupBy(*group, "user_id").agg(
        F.round(F.sum("mean_percentage_watched") * SECONDS_PER_ITEM, 6).alias("total_seconds"),
        F.count(F.lit(1)).alias("items_watched"),
    )


def tier_bins(watch_time: DataFrame, group: list[str] = GROUP, approximate: bool = False) -> DataFrame:
    """p25, p50, p75, p100 and user count per cluster."""
    if approximate:
        cuts = F.percentile_approx("total_seconds", [0.25, 0.5, 0.75, 1.0], 10_000)
        found = watch_time.groupBy(*group).agg(cuts.alias("c"), F.count(F.lit(1)).alias("user_count"))
        names = ["percentile_25", "percentile_50", "percentile_75", "percentile_100"]
        return found.select(*group, *[F.col("c")[i].alias(n) for i, n in enumerate(names)], "user_count")
    positions = ranked(watch_time, group, [F.col("total_seconds"), F.col("user_id")])
    shares = {"percentile_25": 0.25, "percentile_50": 0.5, "percentile_75": 0.75, "percentile_100": 1.0}
    return discrete_percentiles(positions, group, "total_seconds", shares).withColumnRenamed("group_n", "user_count")


#: Size parameter of the sketches: normalised ranks are off by about half a hundredth.
SKETCH_K = 800
_CUTS = {"percentile_25": 0.25, "percentile_50": 0.5, "percentile_75": 0.75, "percentile_100": 1.0}


def watch_time_sketches(watch_time: DataFrame, group: list[str] = GROUP, day: str = "day") -> DataFrame:
    """A quantile sketch of the users' seconds for each day and group, to be stored and merged.

    A user counts on the ``day`` of the last item, so every user is in one sketch, and a new day is one more row per group.
    """
    return watch_time.groupBy(*group, day).agg(F.kll_sketch_agg_double("total_seconds", F.lit(SKETCH_K)).alias("sketch"), F.count(F.lit(1)).alias("users"))


def tier_bins_from(sketches: DataFrame, group: list[str] = GROUP, days: tuple[str, str] | None = None, day: str = "day") -> DataFrame:
    """p25, p50, p75, p100 and user count per group from stored sketches, of all days or those in (first, last)."""
    rows = sketches if days is None else sketches.where(F.col(day).between(*[F.lit(d).cast("date") for d in days]))
    merged = rows.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("m"), F.sum("users").alias("user_count"))
    cuts = F.kll_sketch_get_quantile_double("m", F.array(*[F.lit(p) for p in _CUTS.values()]))
    found = merged.select(*group, cuts.alias("c"), "user_count")
    return found.select(*group, *[F.col("c")[i].alias(n) for i, n in enumerate(_CUTS)], "user_count")


def within_rank_bound(watch_time: DataFrame, exact: DataFrame, near: DataFrame, bound: float, group: list[str] = GROUP) -> DataFrame:
    """The exact bins, and whether every approximate one is a value whose share of users at or below it is within ``bound``."""
    cuts = near.select(*group, *[F.col(n).alias(f"near_{n}") for n in _CUTS], F.col("user_count").alias("near_count"))
    shares = watch_time.join(broadcast_checked(cuts), group).groupBy(*group, "near_count").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("total_seconds") < F.col(f"near_{n}")).alias(f"below_{n}") for n in _CUTS],
        *[F.count_if(F.col("total_seconds") <= F.col(f"near_{n}")).alias(f"upto_{n}") for n in _CUTS],
    )
    fine = F.col("near_count") == F.col("n")
    for name, p in _CUTS.items():
        fine = fine & (F.col(f"below_{name}") / F.col("n") <= p + bound) & (F.col(f"upto_{name}") / F.col("n") >= p - bound)
    return exact.join(shares.select(*group, fine.alias("within_bound")), group)


def ntile_tiers(watch_time: DataFrame, group: list[str] = GROUP, tiers: int = 4) -> DataFrame:
    positions = ranked(watch_time, group, [F.col("total_seconds"), F.col("user_id")])
    return positions.withColumn("bin", ntile_from(F.col("rn"), F.col("group_n"), tiers)).drop("rn", "group_n")


def qcut_tiers(watch_time: DataFrame, group: list[str] = GROUP, tiers: int = 4) -> DataFrame:
    """Equal-frequency tiers at interpolated quantiles with equal edges merged, and the scaled quantile."""
    positions = materialize(ranked(watch_time, group, [F.col("total_seconds"), F.col("user_id")]))
    spots = positions.groupBy(*group).agg(F.max("group_n").alias("n")).select(
        *group, "n", F.explode(F.expr(f"sequence(0, {tiers})")).alias("q")
    ).withColumn("at", (F.col("n") - 1) * F.col("q") / tiers)
    low = positions.select(*group, F.col("rn").alias("lo_rn"), F.col("total_seconds").alias("lo_v"))
    high = positions.select(*group, F.col("rn").alias("hi_rn"), F.col("total_seconds").alias("hi_v"))
    spots = spots.withColumn("lo_rn", F.floor("at") + 1).withColumn("hi_rn", F.ceil("at") + 1)
    value = F.col("lo_v") + (F.col("hi_v") - F.col("lo_v")) * (F.col("at") - F.floor("at"))
    edges = (
        spots.join(low, [*group, "lo_rn"]).join(high, [*group, "hi_rn"])
        .groupBy(*group).agg(F.array_sort(F.collect_set(F.round(value, 6))).alias("edges"))
    )
    inner = F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))")
    bins = F.size(F.filter(inner, lambda e: e < F.col("total_seconds")))
    return (
        watch_time.join(broadcast_checked(edges), group)
        .withColumn("bin", bins)
        .withColumn("quantile", F.col("bin") / (tiers - 1))
        .drop("edges")
    )


def tier_items(interactions: DataFrame, tiers: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Distinct items seen by each tier, one row per item."""
    seen = interactions.select(*group, "user_id", "video_id")
    of_user = tiers.select(*group, "user_id", "bin").hint("shuffle_hash")  # a row for each user: interactions need no sort
    return seen.join(of_user, [*group, "user_id"]).select(*group, "bin", "video_id").distinct()


def lag_tier(sizes: DataFrame) -> DataFrame:
    """Previous (cluster, tier) in order and the comparison flag; runs over the few tier rows only.

    Flag: same cluster TRUE, other cluster and tier FALSE, other cluster but equal tier NULL.
    """
    order = Window.partitionBy("content_type").orderBy("cluster_id", "bin")
    same_cluster = F.coalesce(F.col("prev_cluster_id") == F.col("cluster_id"), F.lit(False))
    same_bin = F.coalesce(F.col("prev_bin") == F.col("bin"), F.lit(False))
    return (
        sizes.withColumn("prev_cluster_id", F.lag("cluster_id").over(order))
        .withColumn("prev_bin", F.lag("bin").over(order))
        .withColumn("num_cx", F.coalesce(F.lag("num_items").over(order), F.lit(0)))
        .withColumn("flag_same_cluster", same_cluster)
        .withColumn("flag_same_bin", same_bin)
        .withColumn("flag_compare", F.when(~same_cluster & ~same_bin, False).when(same_cluster & ~same_bin, True))
    )


def tier_progression(items: DataFrame, flow: DataFrame) -> DataFrame:
    """Items of the previous tier that this tier has not seen, one row per item."""
    compared = flow.where(F.col("flag_compare")).select("content_type", "cluster_id", "bin", "prev_bin")
    previous = items.withColumnRenamed("bin", "prev_bin").join(
        broadcast_checked(compared), ["content_type", "cluster_id", "prev_bin"]
    )
    return previous.select("content_type", "cluster_id", "bin", "video_id").join(
        items, ["content_type", "cluster_id", "bin", "video_id"], "left_anti"
    )


def tier_pairs(items: DataFrame, min_items: int = 100) -> DataFrame:
    """Consecutive tiers worth comparing with their list sizes; lists stay in ``tier_items``."""
    sizes = items.groupBy("content_type", "cluster_id", "bin").agg(F.count(F.lit(1)).alias("num_items"))
    flow = materialize(lag_tier(sizes))
    left_over = tier_progression(items, flow).groupBy("content_type", "cluster_id", "bin").agg(
        F.count(F.lit(1)).alias("num_progression")
    )
    keep = F.col("flag_compare").isNull() | (
        F.col("flag_compare") & (F.col("num_items") > min_items) & (F.col("num_cx") > min_items)
    )
    return (
        flow.where(keep)
        .join(left_over, ["content_type", "cluster_id", "bin"], "left")
        .select(
            "content_type", "cluster_id", "bin", "prev_cluster_id", "prev_bin", "flag_same_cluster", "flag_same_bin",
            "flag_compare", F.coalesce("num_progression", F.lit(0)).alias("num_progression"), "num_cx",
            F.col("num_items").alias("num_cy"),
        )
    )


def with_source_bin(pairs: DataFrame) -> DataFrame:
    """``source_bin`` of the flow label is the previous kept tier; ``prev_bin`` is the true one."""
    w = Window.partitionBy("content_type", "cluster_id").orderBy("bin")
    return (
        pairs.where(F.col("flag_compare"))
        .withColumn("source_bin", F.lag("bin").over(w))
        .withColumn("comparison_flow", ids.flow_label(F.col("cluster_id"), F.col("source_bin"), F.col("bin")))
    )


@dataclass
class SamplePlan:
    """Chosen query items with their random start, and the shuffled targets with their place ``rn``."""

    queries: DataFrame  # content_type, cluster_id, bin, comparison_flow, query_video_id, start, n
    targets: DataFrame  # content_type, cluster_id, bin, rn, candidate_video_id
    per_query: int


FLOW = ["content_type", "cluster_id", "bin"]


def sample_plan(items: DataFrame, pairs: DataFrame, seed: str, queries: int = 300, targets: int = 200) -> SamplePlan:
    """Up to ``queries`` random items of the lower tier, each with up to ``targets`` random items of the upper.

    The upper tier is shuffled once; every query takes consecutive places from its own random
    start. Work is queries x targets however long the lists are.
    """
    flows = broadcast_checked(with_source_bin(pairs).select(*FLOW, "prev_bin", "comparison_flow", F.col("num_cy").alias("n")))
    lower = items.withColumnRenamed("bin", "prev_bin").join(flows, ["content_type", "cluster_id", "prev_bin"])
    start = ids.hash_number(seed + "s", F.col("video_id")) % F.col("n")
    chosen = top_n(lower, FLOW, [ids.hash_order(seed + "q", F.col("video_id")), F.col("video_id")], queries)
    chosen = chosen.select(*FLOW, "comparison_flow", F.col("video_id").alias("query_video_id"), start.alias("start"), "n")
    upper = items.join(flows.select(*FLOW), FLOW).withColumn("_h", ids.hash_order(seed + "t", F.col("video_id")))
    shuffled = ranked(upper, FLOW, [F.col("_h"), F.col("video_id")])
    return SamplePlan(
        materialize(chosen),  # a few hundred rows of a flow, read by several steps
        shuffled.select(*FLOW, "rn", F.col("video_id").alias("candidate_video_id")),
        targets,
    )


def tier_samples(plan: SamplePlan) -> DataFrame:
    """The sampled (query, candidate) pairs."""
    slots = F.sequence(F.lit(0), F.least(F.lit(plan.per_query), F.col("n")).cast("int") - 1)
    placed = plan.queries.withColumn("slot", F.explode(slots)).withColumn("rn", (F.col("start") + F.col("slot")) % F.col("n") + 1)
    return placed.join(plan.targets, [*FLOW, "rn"]).drop("rn", "slot", "n", "start")


def tier_distances(plan: SamplePlan, embeddings: DataFrame | Callable[[DataFrame], DataFrame], limit: float | None = 0.336, chunk: int = 1000) -> DataFrame:
    """Cosine distance of each sampled pair, those under ``limit`` only.

    Vectors move once per item, not once per pair: targets are cut into runs of ``chunk``
    places, a query goes to the one or two runs its places fall in, and a task multiplies both.
    Only the places that a query takes have their vectors read, so their number goes with the queries and not with the
    tiers. ``embeddings`` (video_id, avg_embedding) may be a function that gives those of wanted ids (video_id).
    """
    per_query = plan.per_query
    slots = F.sequence(F.lit(0), F.least(F.lit(per_query), F.col("n")).cast("int") - 1)
    place = lambda s: (F.col("start") + s) % F.col("n")
    asked = plan.queries.withColumn("run", F.explode(F.array_distinct(F.transform(slots, lambda s: F.floor(place(s) / chunk)))))
    taken = plan.queries.select(*FLOW, F.explode(F.transform(slots, lambda s: place(s) + 1)).alias("rn")).distinct()
    wanted = store(
        plan.targets.withColumn("run", F.floor((F.col("rn") - 1) / chunk))
        .join(broadcast_checked(asked.select(*FLOW, "run").distinct()), [*FLOW, "run"], "left_semi")
        .join(taken, [*FLOW, "rn"], "left_semi")
    )
    if not isinstance(embeddings, DataFrame):
        names = plan.queries.select(F.col("query_video_id").alias("video_id")).unionByName(wanted.select(F.col("candidate_video_id").alias("video_id")))
        embeddings = embeddings(names.distinct())
    unit = embeddings.select("video_id", vectors.l2_normalise(F.col("avg_embedding")).alias("unit"))
    q = asked.join(unit.select(F.col("video_id").alias("query_video_id"), "unit"), "query_video_id")
    t = wanted.join(unit.select(F.col("video_id").alias("candidate_video_id"), "unit"), "candidate_video_id")
    bound = float("inf") if limit is None else limit

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*FLOW, "query_video_id", "comparison_flow", "candidate_video_id", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        gap = np.round(1.0 - np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T, 9)
        place = (right["rn"].to_numpy()[None, :] - 1 - left["start"].to_numpy()[:, None]) % left["n"].to_numpy()[:, None]
        apart = left["query_video_id"].to_numpy()[:, None] != right["candidate_video_id"].to_numpy()[None, :]
        rows, cols = np.nonzero((place < per_query) & apart & (gap < bound))
        found = left[[*FLOW, "query_video_id", "comparison_flow"]].iloc[rows].reset_index(drop=True)
        found["candidate_video_id"] = right["candidate_video_id"].to_numpy()[cols]
        found["distance"] = gap[rows, cols]
        return found[names]

    keys = [*FLOW, "run"]
    t = t.select(*[F.col(c).alias(c) for c in t.columns])  # both sides stem from one table
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(
        measure, "content_type string, cluster_id int, bin int, query_video_id string, comparison_flow string, candidate_video_id string, distance double"
    )


def tier_candidates(items: DataFrame, pairs: DataFrame, embeddings: DataFrame | Callable[[DataFrame], DataFrame], seed: str = "tier",
                    limit: float = 0.336, top_share: float = 0.15, keep: int = 30) -> DataFrame:
    near = tier_distances(sample_plan(items, pairs, seed), embeddings, limit)
    query = ["content_type", "cluster_id", "bin", "query_video_id"]
    ordered = Window.partitionBy(*query).orderBy("distance")
    best = near.withColumn("share", F.percent_rank().over(ordered)).where(F.col("share") <= top_share)
    lot = [ids.hash_order(seed + "k", F.col("query_video_id"), F.col("candidate_video_id")), F.col("candidate_video_id")]
    return top_n(best, query, lot, keep).select(
        "content_type", "cluster_id", "bin", "query_video_id", "comparison_flow", "candidate_video_id", "distance"
    )
