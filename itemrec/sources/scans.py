"""Filtered reads whose predicates and columns reach the file scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids in a Python list up to which a filter with all of them is pushed to the scan.
SHORT_LIST = 1000


def _table(df: DataFrame, column: str, wanted) -> DataFrame:
    """Wanted ids, from a DataFrame's first column or a Python list, as a table of distinct ids."""
    if not isinstance(wanted, DataFrame):
        wanted = df.sparkSession.createDataFrame([(x,) for x in wanted], f"`{column}` {df.schema[column].dataType.simpleString()}")
    return wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()


def _among(df: DataFrame, *columns: str, wanted) -> DataFrame:
    """Rows with a wanted id in any of ``columns``: a short Python list becomes a pushed IN filter, others a join."""
    if wanted is None:
        return df
    if not isinstance(wanted, DataFrame) and len(wanted) <= SHORT_LIST:
        among = [F.col(c).isin(list(wanted)) for c in columns]
        return df.where(reduce(or_, among))
    table = _table(df, columns[0], wanted)
    if len(columns) == 1:
        return df.join(table, F.col(columns[0]) == F.col("_wanted"), "left_semi")
    rows = df
    for i, c in enumerate(columns):
        rows = rows.join(table.select(F.col("_wanted").alias(f"_wanted_{i}")), F.col(c) == F.col(f"_wanted_{i}"), "left")
    return rows.where(F.coalesce(*[F.col(f"_wanted_{i}") for i in range(len(columns))]).isNotNull()).select(*df.columns)


def scan_interactions(interactions: DataFrame, start: str | None = None, end: str | None = None,
                      users=None, items=None, limit: int | None = None) -> DataFrame:
    """Newest first; ``end`` includes the whole day."""
    df = interactions
    if start:
        df = df.where(F.col("last_watched_timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("last_watched_timestamp") <= F.lit(end + " 23:59:59").cast("timestamp"))
    df = _among(_among(df, "user_id", wanted=users), "video_id", wanted=items)
    df = df.orderBy(F.col("last_watched_timestamp").desc(), "user_id", "video_id")
    return df if limit is None else df.limit(limit)


def scan_item_index(index: DataFrame, columns: list[str], uris=None, canisters=None, posts=None,
                    is_nsfw: bool | None = None, limit: int | None = None) -> DataFrame:
    df = _among(_among(_among(index, "uri", wanted=uris), "canister_id", wanted=canisters), "post_id", wanted=posts)
    if is_nsfw is not None:
        df = df.where(F.col("is_nsfw") == is_nsfw)
    df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def scan_duplicates(duplicates: DataFrame, min_score: float | None = None, exact_only: bool = False,
                    items=None, limit: int | None = None) -> DataFrame:
    """``items`` may match either side of a pair."""
    df = duplicates
    if min_score is not None:
        df = df.where(F.col("duplication_score") >= min_score)
    if exact_only:
        df = df.where(F.col("exact_duplicate"))
    df = _among(df, "original_video_id", "parent_video_id", wanted=items)
    df = df.orderBy(F.col("duplication_score").desc(), "original_video_id")
    return df if limit is None else df.limit(limit)


def window_starts(bounds: DataFrame, days: int = 7) -> DataFrame:
    """Starts of consecutive ``days``-long windows between ``first`` and ``last``."""
    return bounds.select(F.explode(F.expr(f"sequence(cast(first as date), cast(last as date), interval {days} days)")).alias("window_start"))


def with_window_start(df: DataFrame, stamp: str, first: str, days: int = 7) -> DataFrame:
    """Start of the window each row falls in, counted from ``first``."""
    offset = F.floor(F.datediff(F.col(stamp), F.lit(first).cast("date")) / days) * days
    return df.withColumn("window_start", F.date_add(F.lit(first).cast("date"), offset.cast("int")))


def pending_windows(bounds: DataFrame, written: DataFrame, days: int = 7) -> DataFrame:
    """Windows not written yet."""
    return window_starts(bounds, days).join(written.select("window_start").distinct(), "window_start", "left_anti")
