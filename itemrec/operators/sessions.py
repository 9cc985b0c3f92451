"""Watch sessions and session baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.operators.ranking import ranked

SESSION_GAP_SECONDS = 600


def sessionize(events: DataFrame, user: str = "user_id", stamp: str = "ts", tie: str = "event_id",
               gap: int = SESSION_GAP_SECONDS, slice_seconds: int = 3600) -> DataFrame:
    """Zero-based session number per user; a new one starts when the gap exceeds ``gap`` whole seconds.

    Two levels, so a very active user is not one task: rows are numbered inside hour slices,
    and only one summary row per (user, hour) is carried across slices.
    """
    sliced = events.withColumn("_slice", F.floor(F.unix_seconds(stamp) / slice_seconds))
    inside = Window.partitionBy(user, "_slice").orderBy(stamp, tie)
    micros = lambda c: F.unix_micros(c)
    gap_of = lambda later, earlier: F.floor((micros(later) - micros(earlier)) / 1_000_000)
    rows = sliced.withColumn("_prev", F.lag(stamp).over(inside)).withColumn(
        "_new", F.when(F.col("_prev").isNotNull(), (gap_of(F.col(stamp), F.col("_prev")) > gap).cast("int")).otherwise(0)
    )
    summary = rows.groupBy(user, "_slice").agg(
        F.min(stamp).alias("_from"), F.max(stamp).alias("_to"), F.sum("_new").alias("_inner")
    )
    across = Window.partitionBy(user).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        summary.withColumn("_gap", gap_of(F.col("_from"), F.lag("_to").over(across)))
        .withColumn("_enter", F.coalesce((F.col("_gap") > gap).cast("int"), F.lit(0)))
        .withColumn("_base", F.sum("_enter").over(across) + F.coalesce(F.sum("_inner").over(before), F.lit(0)))
    )
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_local", F.sum("_new").over(running))
        .join(summary.select(user, "_slice", "_base"), [user, "_slice"])
        .withColumn("session_id", F.col("_base") + F.col("_local"))
        .drop("_slice", "_prev", "_new", "_local", "_base")
    )


def chunk_list(items: Column, size: int = 5, least: int = 2) -> Column:
    """Consecutive lists of ``size``; too short a list gives none, too short a rest joins the list before."""
    n = F.size(items)
    full = F.floor((n + size - 1) / size).cast("int")
    rest = n - (full - 1) * size
    count = F.when(n < least, F.lit(0)).when((full > 1) & (rest < least), full - 1).otherwise(full)
    last = lambda k: F.when(k == count - 1, n - k * size).otherwise(F.lit(size))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * size + 1, last(k)))).otherwise(
        F.slice(F.array(items), 1, 0)
    )


def session_baskets(sessions: DataFrame, size: int = 5, least: int = 2) -> DataFrame:
    """Baskets of ``size`` consecutive items per session by position arithmetic; no session-wide list."""
    placed = ranked(sessions, ["user_id", "session_id"], [F.col("ts"), F.col("event_id")], size="n")
    full = F.floor((F.col("n") + size - 1) / size)
    rest = F.col("n") - (full - 1) * size
    baskets = F.when((full > 1) & (rest < least), full - 1).otherwise(full)
    placed = (
        placed.where(F.col("n") >= least)
        .withColumn("pos", F.col("rn") - 1)
        .withColumn("batch_index", F.least(F.floor(F.col("pos") / size), baskets - 1))
    )
    return placed.groupBy("user_id", "session_id", "batch_index").agg(
        F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("_items")
    ).select("user_id", "session_id", "batch_index", F.transform("_items", lambda s: s["item_id"]).alias("items"))
