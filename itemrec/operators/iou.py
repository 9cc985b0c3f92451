"""Item pairs that share finishing users, scored by overlap over audience.

score = round2(num / den) * 2 with num = finishing users of x that also finished y and
den = the two minimum-watch audience sizes added. Kept: scores above the group's 95th
percentile over all pairs with num > 0. A group is (content_type, cluster_id).

Only pairs sharing a user can score, so pairs come from joining a user's items with each
other. Two cases are kept apart so that one very active user cannot dominate the job:

* most users: their items are cut into blocks and the blocks paired, so no task gets a
  user's whole square, and each unordered pair is produced once for both directions;
* users of a group with more items than ``heavy_items``, however many: their pairs are never produced. They
  are bits of an array that each of their items has, and what two items share is the number of
  bits that both have. Items with the same bits and the same audience size score alike, so classes of such items
  are counted against each other, block of classes by block of classes, and only what passes the cut is written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.functions import rules
from itemrec.runtime import broadcast_checked, materialize

MIN_WATCH = 0.5
SUCCESS_WATCH = 0.75
MIN_USERS = 2
GROUP = ["content_type", "cluster_id"]
#: Items of a user above which its pairs are counted by bits, and classes of one block of them.
HEAVY_ITEMS, CLASS_BLOCK = 5_000, 1_000


def item_audiences(split: DataFrame, min_watch: float = MIN_WATCH, success: float = SUCCESS_WATCH) -> DataFrame:
    """Per group and item: audience list lengths and distinct users at both thresholds.

    Two levels of counting (per user, then per item) replace two distinct counts in one pass.
    """
    watched = F.col("mean_percentage_watched")
    per_user = (
        split.where(F.col("content_type").isNotNull() & (watched > F.lit(min(min_watch, success))))
        .groupBy(*GROUP, "video_id", "user_id")
        .agg(F.count_if(watched > min_watch).alias("n_min"), F.count_if(watched > success).alias("n_success"))
    )
    return per_user.groupBy(*GROUP, "video_id").agg(
        F.sum("n_min").alias("n_min"),
        F.count_if(F.col("n_min") > 0).alias("users_min"),
        F.sum("n_success").alias("n_success"),
        F.count_if(F.col("n_success") > 0).alias("users_success"),
    )


def _finished(split: DataFrame, min_watch: float, success: float, min_users: int) -> DataFrame:
    """One row per (group, item, finishing user) of qualifying items: repeats ``w`` and audience ``n``."""
    items = item_audiences(split, min_watch, success).where(
        (F.col("users_min") >= min_users) & (F.col("users_success") >= min_users)
    )
    rows = (
        split.where(F.col("content_type").isNotNull() & (F.col("mean_percentage_watched") > success))
        .groupBy(*GROUP, "video_id", "user_id")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    of_item = items.select(*GROUP, "video_id", F.col("n_min").alias("n")).hint("shuffle_hash")  # a row for each item: the others need no sort
    return rows.join(of_item, [*GROUP, "video_id"])


def _user_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Unordered co-finished pairs lo < hi with shared counts in both directions."""
    counts = rows.groupBy(*GROUP, "user_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = rows.join(counts.hint("shuffle_hash"), [*GROUP, "user_id"]).withColumn("b", F.expr("cast(pmod(hash(video_id), blocks) as int)"))
    keys = [*GROUP, "user_id", "bx", "by"]
    left = placed.select(
        *GROUP, "user_id", F.col("b").alias("bx"),
        F.explode(F.expr("sequence(b, blocks - 1)")).alias("by"),
        F.col("video_id").alias("x"), F.col("w").alias("wx"), F.col("n").alias("nx"),
    )
    right = placed.select(
        *GROUP, "user_id", F.explode(F.expr("sequence(0, b)")).alias("bx"), F.col("b").alias("by"),
        F.col("video_id").alias("y"), F.col("w").alias("wy"), F.col("n").alias("ny"),
    )
    pairs = left.join(right, keys).where((F.col("bx") < F.col("by")) | (F.col("x") < F.col("y")))
    first = F.col("x") < F.col("y")
    side = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return (
        pairs.select(
            *GROUP, side("x", "y", "lo"), side("y", "x", "hi"),
            side("nx", "ny", "n_lo"), side("ny", "nx", "n_hi"), side("wx", "wy", "w_lo"), side("wy", "wx", "w_hi"),
        )
        .groupBy(*GROUP, "lo", "hi", "n_lo", "n_hi")
        .agg(F.sum("w_lo").alias("num_lo"), F.sum("w_hi").alias("num_hi"))
    )


def _score(num: Column, den: Column) -> Column:
    return rules.round2(num / den) * 2


def _shared(bits: Column, has: Column) -> Column:
    """How many bits two arrays have in common."""
    return F.aggregate(F.zip_with(bits, has, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _products(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared counts of every left class with every right one, and of every right one with every left one."""
    a, b, has_a, has_b = (np.stack(df[c].to_numpy()).astype(np.int64).view(np.uint64) for c in ("bits", "has") for df in (left, right))
    out = np.zeros((2, len(left), len(right)), np.int64)
    for i in range(a.shape[1]):
        out[0] += np.bitwise_count(a[:, i, None] & has_b[None, :, i])
        out[1] += np.bitwise_count(has_a[:, i, None] & b[None, :, i])
    return out[0], out[1]


class HeavyUsers:
    """The items of very active users, as bitmaps over those users.

    ``rows`` are one per (group, item, user) with repeats ``w`` and audience ``n``. ``bits`` of an item has a level for each number of
    repeats, with the users that have at least so many; ``has`` is the first level once for each level. So the repeats of x
    by users that have y too are the bits that ``bits`` of x and ``has`` of y share.
    """

    def __init__(self, rows: DataFrame, heavy_items: int = HEAVY_ITEMS, block: int = CLASS_BLOCK):
        self.block = block
        sizes = rows.groupBy(*GROUP, "user_id").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > heavy_items)
        slot = F.row_number().over(Window.partitionBy(*GROUP).orderBy("user_id")) - 1
        heavy = materialize(sizes.withColumn("slot", slot).select(*GROUP, "user_id", "slot"))
        slots = heavy.agg(F.max("slot")).first()[0]
        self.any = slots is not None
        self.light = rows
        if not self.any:
            return
        marked = rows.join(heavy, [*GROUP, "user_id"], "left")
        self.light = marked.where(F.col("slot").isNull()).drop("slot")
        held = materialize(marked.where(F.col("slot").isNotNull()).select(*GROUP, "video_id", "n", "w", "slot"))
        words, levels = slots // 64 + 1, int(held.agg(F.max("w")).first()[0])
        place = (F.col("level") - 1) * words + F.floor(F.col("slot") / 64)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))
        placed = held.withColumn("level", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("w")))).withColumn("place", place.cast("int"))
        packed = placed.groupBy(*GROUP, "video_id", "n", "place").agg(F.bit_or(bit).alias("word"))
        maps = packed.groupBy(*GROUP, "video_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "word"))).alias("m"))
        zero = F.lit(0).cast("bigint")
        whole = F.transform(F.sequence(F.lit(0), F.lit(words * levels - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero))
        self.items = materialize(
            maps.withColumn("bits", whole).withColumn("has", F.flatten(F.array_repeat(F.slice("bits", 1, words), levels))).drop("m")
        )

    def added(self, listed: DataFrame) -> DataFrame:
        """Listed pairs (lo, hi, n_lo, n_hi, num_lo, num_hi) with what heavy users add, and that alone as heavy_lo and heavy_hi."""
        side = lambda s: self.items.select(*GROUP, F.col("video_id").alias(s), F.col("bits").alias(f"bits_{s}"), F.col("has").alias(f"has_{s}"))
        joined = listed.join(side("lo"), [*GROUP, "lo"], "left").join(side("hi"), [*GROUP, "hi"], "left")
        zero = F.lit(0).cast("bigint")
        joined = joined.withColumn("heavy_lo", F.coalesce(_shared(F.col("bits_lo"), F.col("has_hi")), zero))
        joined = joined.withColumn("heavy_hi", F.coalesce(_shared(F.col("bits_hi"), F.col("has_lo")), zero))
        joined = joined.withColumn("num_lo", F.col("num_lo") + F.col("heavy_lo")).withColumn("num_hi", F.col("num_hi") + F.col("heavy_hi"))
        return joined.drop("bits_lo", "bits_hi", "has_lo", "has_hi")

    def classes(self, members: DataFrame) -> DataFrame:
        """Distinct (group, bits, n) with a number and how many items each has."""
        sizes = members.groupBy(*GROUP, "bits", "has", "n").agg(F.count(F.lit(1)).alias("c"))
        return materialize(sizes.withColumn("number", F.monotonically_increasing_id()))

    def products(self, classes: DataFrame, visit, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """``visit(left, right, num, num_back, same)`` for every two blocks of classes of a group; ``extra`` joins the left side by group.

        A class goes to each block of its row and of its column, so a task has two blocks whatever the size of a group.
        """
        counts = classes.groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("blocks"))
        placed = classes.join(counts, GROUP).withColumn("b", F.expr("cast(pmod(xxhash64(number), blocks) as int)"))
        left = placed.withColumn("rb", F.col("b")).withColumn("cb", F.explode(F.expr("sequence(b, blocks - 1)"))).drop("b", "blocks")
        left = left if extra is None else left.join(extra, GROUP)
        right = placed.withColumn("rb", F.explode(F.expr("sequence(0, b)"))).withColumn("cb", F.col("b")).drop("b", "blocks")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides stem from one table
        names = [x.split()[0] for x in schema.split(", ")]

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame(columns=names)
            return visit(a, b, *_products(a, b), a["rb"].iloc[0] == a["cb"].iloc[0])[names]

        keys = [*GROUP, "rb", "cb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _directions(left: pd.DataFrame, right: pd.DataFrame, num: np.ndarray, back: np.ndarray, same: bool) -> list[tuple]:
    """(first, second, counts) of the ordered pairs of two blocks: both ways, or once where a block meets itself."""
    return [(left, right, num)] if same else [(left, right, num), (right, left, back.T)]


def _scores(num: np.ndarray, first: pd.DataFrame, second: pd.DataFrame) -> np.ndarray:
    return np.floor(num / (first["n"].to_numpy()[:, None] + second["n"].to_numpy()[None]) * 100 + 0.5) / 100 * 2


class PairScores:
    """The scored pairs of every group in factored form: user pairs listed, heavy users' pairs as classes."""

    def __init__(self, split: DataFrame, min_watch: float = MIN_WATCH, success: float = SUCCESS_WATCH,
                 min_users: int = MIN_USERS, heavy_items: int = HEAVY_ITEMS, block: int = 500, class_block: int = CLASS_BLOCK):
        finished = materialize(_finished(split, min_watch, success, min_users))
        self.heavy = HeavyUsers(finished, heavy_items, class_block)
        self.has_heavy = self.heavy.any
        pairs = _user_pairs(self.heavy.light, block)
        extra = ["heavy_lo", "heavy_hi"] if self.has_heavy else []
        pairs = self.heavy.added(pairs) if self.has_heavy else pairs
        self.listed = materialize(pairs.select(*GROUP, "lo", "hi", (F.col("n_lo") + F.col("n_hi")).alias("den"), "num_lo", "num_hi", *extra))
        if self.has_heavy:
            # audiences over 200 times the largest shared count all round to a zero score: one class
            total = F.aggregate("bits", F.lit(0).cast("bigint"), lambda acc, x: acc + F.bit_count(x))
            most = self.heavy.items.groupBy(*GROUP).agg(F.max(total).alias("most"))
            self.members = materialize(
                self.heavy.items.join(broadcast_checked(most), GROUP).withColumn("size", F.col("n")).withColumn("n", F.least(F.col("n"), F.col("most") * 200 + 1)).drop("most")
            )
            self.classes = self.heavy.classes(self.members)

    def _class_histogram(self) -> DataFrame:
        def count(left, right, num, back, same):
            found = []
            for first, second, n in _directions(left, right, num, back, same):
                pairs = first["c"].to_numpy()[:, None] * second["c"].to_numpy()[None]
                if same:
                    pairs -= np.where(first["number"].to_numpy()[:, None] == second["number"].to_numpy()[None], first["c"].to_numpy()[:, None], 0)
                at = (n > 0) & (pairs > 0)
                found.append(pd.DataFrame({"score": _scores(n, first, second)[at], "pairs": pairs[at]}))
            return pd.concat(found).groupby("score", as_index=False)["pairs"].sum().assign(**{g: left[g].iloc[0] for g in GROUP})

        rows = self.heavy.products(self.classes, count, "content_type string, cluster_id int, score double, pairs bigint")
        return rows.groupBy(*GROUP, "score").agg(F.sum("pairs").alias("pairs"))

    def _class_pairs(self, limits: DataFrame) -> DataFrame:
        """Ordered pairs of classes above their group's limit."""
        def pick(left, right, num, back, same):
            found = []
            for first, second, n in _directions(left, right, num, back, same):
                score = _scores(n, first, second)
                i, j = np.nonzero((n > 0) & (score > left["p95"].iloc[0]))
                found.append(pd.DataFrame({"a": first["number"].to_numpy()[i], "b": second["number"].to_numpy()[j], "num": n[i, j], "score": score[i, j]}))
            return pd.concat(found).assign(**{g: left[g].iloc[0] for g in GROUP})

        return self.heavy.products(self.classes, pick, "content_type string, cluster_id int, a bigint, b bigint, num bigint, score double", limits)

    def directed(self) -> DataFrame:
        """Listed pairs in both directions."""
        extra = ["heavy_lo", "heavy_hi"] if self.has_heavy else []
        one = F.struct(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("num_lo").alias("num"),
                       (F.col("heavy_lo") if extra else F.lit(0).cast("bigint")).alias("heavy"))
        two = F.struct(F.col("hi").alias("x"), F.col("lo").alias("y"), F.col("num_hi").alias("num"),
                       (F.col("heavy_hi") if extra else F.lit(0).cast("bigint")).alias("heavy"))
        return (
            self.listed.select(*GROUP, "den", F.explode(F.array(one, two)).alias("p"))
            .select(*GROUP, "p.x", "p.y", "den", "p.num", "p.heavy")
            .withColumn("score", _score(F.col("num"), F.col("den")))
        )

    def histogram(self) -> DataFrame:
        """Pairs with num > 0 per group and score: at most a few hundred rows per group."""
        listed = self.directed()
        parts = listed.groupBy(*GROUP, "score").agg(F.count(F.lit(1)).alias("pairs"))
        if self.has_heavy:
            counted = self._class_histogram()
            twice = (
                listed.where(F.col("heavy") > 0)
                .withColumn("score", _score(F.col("heavy"), F.col("den")))
                .groupBy(*GROUP, "score").agg((-F.count(F.lit(1))).alias("pairs"))
            )
            parts = (
                parts.unionByName(counted).unionByName(twice)
                .groupBy(*GROUP, "score").agg(F.sum("pairs").alias("pairs")).where(F.col("pairs") > 0)
            )
        return parts

    def thresholds(self, share: float = 0.95) -> DataFrame:
        """Exact discrete percentile of the scores, read off the histogram."""
        running = Window.partitionBy(*GROUP).orderBy("score")
        whole = Window.partitionBy(*GROUP)
        return (
            self.histogram()
            .withColumn("below", F.sum("pairs").over(running))
            .withColumn("total", F.sum("pairs").over(whole))
            .where(F.col("below") >= F.ceil(F.col("total") * F.lit(share)))
            .groupBy(*GROUP).agg(F.min("score").alias("p95"))
        )

    def above(self, limits: DataFrame) -> DataFrame:
        """All directed pairs scoring above their group's limit."""
        listed = self.directed()
        kept = listed.join(limits, GROUP).where(F.col("score") > F.col("p95")).select(*GROUP, "x", "y", "den", "num", "score")
        if not self.has_heavy:
            return kept
        numbered = materialize(self.members.join(self.classes.select(*GROUP, "bits", "n", "number"), [*GROUP, "bits", "n"]).select("number", "video_id", "size"))
        side = lambda c, item, size: numbered.select(F.col("number").alias(c), F.col("video_id").alias(item), F.col("size").alias(size))
        rare = (
            self._class_pairs(limits).join(side("a", "x", "size_x"), "a").join(side("b", "y", "size_y"), "b").where(F.col("x") != F.col("y"))
            .select(*GROUP, "x", "y", (F.col("size_x") + F.col("size_y")).alias("den"), "num", "score")
        )
        return kept.unionByName(rare.join(listed.select(*GROUP, "x", "y"), [*GROUP, "x", "y"], "left_anti"))


def iou_candidates(split: DataFrame, percentile: float = 0.95, **options) -> DataFrame:
    """Candidate pairs per content type and cluster; both directions."""
    scores = PairScores(split, **options)
    limits = broadcast_checked(scores.thresholds(percentile))
    return scores.above(limits).select(
        *GROUP, F.col("x").alias("video_id_x"), F.col("y").alias("video_id_y"), "den", "num",
        F.col("score").alias("iou_modified"),
    )


def pair_score_profile(split: DataFrame, **options) -> DataFrame:
    """All ordered item pairs of each cluster by score, the unrelated ones counted, not produced."""
    min_users = options.get("min_users", MIN_USERS)
    audiences = item_audiences(split, options.get("min_watch", MIN_WATCH), options.get("success", SUCCESS_WATCH))
    items = audiences.where((F.col("users_min") >= min_users) & (F.col("users_success") >= min_users))
    everything = items.groupBy(*GROUP).agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("all_pairs"))
    related = materialize(PairScores(split, **options).histogram())
    found = related.groupBy(*GROUP).agg(F.sum("pairs").alias("related"))
    unrelated = (
        everything.join(found, GROUP, "left")
        .select(*GROUP, F.lit(None).cast("double").alias("score"), (F.col("all_pairs") - F.coalesce("related", F.lit(0))).alias("pairs"))
        .where(F.col("pairs") > 0)
    )
    return related.unionByName(unrelated)


def _heavy_pairs(heavy: HeavyUsers) -> DataFrame:
    """Unordered pairs of items that share heavy users, each made once: from pairs of classes, by their members."""
    classes = heavy.classes(heavy.items)

    def pick(left, right, num, back, same):
        i, j = np.nonzero(np.triu(num) if same else num)
        found = pd.DataFrame({"a": left["number"].to_numpy()[i], "b": right["number"].to_numpy()[j], "num_a": num[i, j], "num_b": back[i, j]})
        return found.assign(**{g: left[g].iloc[0] for g in GROUP})

    pairs = heavy.products(classes, pick, "content_type string, cluster_id int, a bigint, b bigint, num_a bigint, num_b bigint")
    numbered = materialize(heavy.items.join(classes.select(*GROUP, "bits", "n", "number"), [*GROUP, "bits", "n"]).select("number", "video_id", "n"))
    side = lambda c: numbered.select(F.col("number").alias(c), F.col("video_id").alias(f"item_{c}"), F.col("n").alias(f"n_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("item_a") < F.col("item_b")))
    first = F.col("item_a") < F.col("item_b")
    pick_of = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(
        *GROUP, pick_of("item_a", "item_b", "lo"), pick_of("item_b", "item_a", "hi"), pick_of("n_a", "n_b", "n_lo"), pick_of("n_b", "n_a", "n_hi"),
        pick_of("num_a", "num_b", "num_lo"), pick_of("num_b", "num_a", "num_hi"),
    )


def pairs_across_clusters(interactions: DataFrame, cluster: str, min_watch: float = MIN_WATCH, success: float = SUCCESS_WATCH,
                          min_users: int = MIN_USERS, block: int = 500, heavy_items: int = HEAVY_ITEMS, class_block: int = CLASS_BLOCK) -> DataFrame:
    """Item pairs of different clusters that share finishing users, with distinct audiences (both directions)."""
    labelled = interactions.where(F.col(cluster).isNotNull()).select(
        F.lit("all").alias("content_type"), F.col(cluster).alias("cluster_id"), "video_id", "user_id", "mean_percentage_watched"
    )
    items = item_audiences(labelled, min_watch, success).where((F.col("users_min") >= min_users) & (F.col("users_success") >= min_users))
    finished = labelled.where(F.col("mean_percentage_watched") > success).select(*GROUP, "video_id", "user_id").distinct()
    rows = finished.join(items.select(*GROUP, "video_id", F.col("users_min").alias("n")), [*GROUP, "video_id"])
    # the pair join runs over one common group; the real cluster travels inside the item key
    keyed = rows.select(
        "content_type", F.lit(0).alias("cluster_id"), F.struct(F.col("cluster_id").alias("c"), F.col("video_id").alias("v")).alias("video_id"),
        "user_id", F.lit(1).cast("bigint").alias("w"), "n",
    )
    heavy = HeavyUsers(materialize(keyed), heavy_items, class_block)
    pairs = _user_pairs(heavy.light, block)
    if heavy.any:
        pairs = materialize(heavy.added(pairs).drop("heavy_lo", "heavy_hi"))
        pairs = pairs.unionByName(_heavy_pairs(heavy).join(pairs, [*GROUP, "lo", "hi"], "left_anti").select(*pairs.columns))
    pairs = pairs.where((F.col("lo.c") != F.col("hi.c")) & (F.col("lo.v") != F.col("hi.v")))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("y"))))
    both = pairs.select(ends.alias("p"), (F.col("n_lo") + F.col("n_hi")).alias("den"), F.col("num_lo").alias("num"))
    return both.select(
        F.col("p.x.c").alias("cluster_id_x"), F.col("p.y.c").alias("cluster_id_y"),
        F.col("p.x.v").alias("video_id_x"), F.col("p.y.v").alias("video_id_y"), "den", "num",
    )
