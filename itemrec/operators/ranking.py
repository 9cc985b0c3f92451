"""Positions, tiers and bounded lists for groups of any size.

A window over a group runs the whole group in one task. These forms sort by range
instead, so a group that holds a third of the table is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemrec.runtime import broadcast_checked, materialize

#: Spark's own bound (spark.sql.optimizer.windowGroupLimitThreshold) for limiting a window's groups before the shuffle.
WINDOW_LIMIT = 1000


def ranked(df: DataFrame, group: list[str], order: list[Column], position: str = "rn", size: str = "group_n") -> DataFrame:
    """1-based position inside each group, and the group's size.

    Range-partitioned sort, a running number inside each partition, then the rows
    that earlier partitions hold of the same group are added. ``order`` must be a total
    order inside the group.
    """
    keys = [F.col(g) for g in group]
    parts = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_seq", 33))
    )
    parts = materialize(parts)
    by_part = Window.partitionBy(*group, F.lit(0)).orderBy("_part")
    starts = (
        parts.groupBy(*group, "_part")
        .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(size, F.sum("_n").over(Window.partitionBy(*group, F.lit(0))))
    )
    starts = broadcast_checked(starts)  # few rows unless groups are many; else all rows would move once more
    same = F.col("p._part") == F.col("s._part")
    for g in group:
        same = same & F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}"))
    return (
        parts.alias("p")
        .join(starts.alias("s"), same)
        .select(
            *[F.col(f"p.{c}") for c in df.columns],
            (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias(position),
            F.col(size),
        )
    )


def ntile_from(position: Column, n: Column, buckets: int) -> Column:
    """Zero-based equal-count bucket of a position, the larger buckets first."""
    size = F.floor(n / buckets)
    larger = n % buckets
    edge = larger * (size + 1)
    return (
        F.when(position <= edge, F.floor((position - 1) / (size + 1)))
        .otherwise(larger + F.floor((position - 1 - edge) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def with_percent_rank(df: DataFrame, group: list[str], value: str, tie: list[Column], output: str, descending: bool = False) -> DataFrame:
    """``percent_rank`` of ``value`` in its group; equal values share the lowest position."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    positions = ranked(df, group, [first, *tie])
    lowest = positions.groupBy(*group, value).agg(F.min("rn").alias("_rank"))
    return (
        positions.join(lowest, [*group, value])
        .withColumn(
            output,
            F.when(F.col("group_n") > 1, (F.col("_rank") - 1) / (F.col("group_n") - 1)).otherwise(F.lit(0.0)),
        )
        .drop("_rank")
    )


def discrete_percentiles(positions: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact ``percentile_disc`` per group, read off ``ranked`` rows as the value at position ceil(p*n)."""
    picks = [
        F.max(F.when(F.col("rn") == F.greatest(F.ceil(F.col("group_n") * F.lit(p)), F.lit(1)), F.col(value))).alias(name)
        for name, p in shares.items()
    ]
    return positions.groupBy(*group).agg(*picks, F.count(F.lit(1)).alias("group_n"))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, position: str = "rn") -> DataFrame:
    """First ``n`` rows of each group.

    Up to ``WINDOW_LIMIT``, Spark cuts each partition to ``n`` rows a group before the shuffle; more
    rows are numbered by a distributed sort, so that no group fills one task.
    """
    if n > WINDOW_LIMIT:
        rows = ranked(df, group, order, position, "_group_n").where(F.col(position) <= n)
        return rows.withColumn(position, F.col(position).cast("int")).drop("_group_n")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def paged_lists(df: DataFrame, group: list[str], order: list[Column], value: Column, page_size: int = 1000) -> DataFrame:
    """Each group's ordered values as consecutive lists of at most ``page_size``: whole, never one huge array."""
    pages = ranked(df, group, order).withColumn("page", F.floor((F.col("rn") - 1) / page_size).cast("int"))
    lists = pages.groupBy(*group, "page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rn"), value.alias("value")))).alias("_items")
    )
    return lists.select(*group, "page", F.transform("_items", lambda s: s["value"]).alias("items"))

