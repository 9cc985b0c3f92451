"""Checks that jobs run on their own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from itemrec.runtime import store


def _observed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that the job which writes it counts along: rows, nulls and range of each key, and a sum over all keys."""
    seen = Observation()
    fingerprint = F.sum(F.xxhash64(*keys).bitwiseAND(0xFFFFFFFF)) if keys else F.sum(F.lit(0))
    ranges = [m for k in keys for m in (F.count_if(F.col(k).isNull()).alias(f"nulls_{k}"), F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}"))]
    return df.observe(seen, F.count(F.lit(1)).alias("num_rows"), fingerprint.alias("keys"), *ranges), seen


def store_observed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict]:
    """A stored table and its metrics, from one run of the plan."""
    watched, seen = _observed(df, keys)
    return store(watched), seen.get


def expect_non_empty(df: DataFrame, stage: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The stored rows of ``df``; refused if the write saw none, or a null in a key."""
    table, metrics = store_observed(df, list(keys))
    if not metrics["num_rows"]:
        raise ValueError(f"stage {stage} wrote no rows")
    if broken := [k for k in keys if metrics[f"nulls_{k}"]]:
        raise ValueError(f"stage {stage} wrote nulls in {', '.join(broken)}")
    return table


def row_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per stage and whether any exist, counted by the jobs that write the stages."""
    rows = [(n, store_observed(df, [])[1]["num_rows"]) for n, df in parts.items()]
    spark = next(iter(parts.values())).sparkSession
    return spark.createDataFrame(rows, "stage string, num_rows bigint").withColumn("non_empty", F.col("num_rows") > 0)


def expect_keys_in_source(stored: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Key rows on one side only, marked with their side; the tables are compared only if what their writes counted differs."""
    (left, a), (right, b) = (store_observed(df.select(*keys), keys) for df in (stored, source))
    return difference(left, right) if a != b else difference(left.limit(0), right.limit(0))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, repeats counted, marked with their side.

    Both sides move once, and meet where equal rows are added up; few are equal before, so they aren't added up there.
    """
    names = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    apart = both.repartition(*names).groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))).alias("_i")
    return apart.select(*names, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), times).drop("_i")


def vector_shape_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and vector lengths per column in one pass."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("vector_column"), F.size(c).alias("length"), F.col(c).isNull().alias("missing")) for c in columns
    ])).alias("v")).select("v.*")
    return rows.groupBy("vector_column").agg(
        F.count(F.lit(1)).alias("num_rows"), F.count_if("missing").alias("missing"),
        F.min(F.when(~F.col("missing"), F.col("length"))).alias("min_length"),
        F.max(F.when(~F.col("missing"), F.col("length"))).alias("max_length"),
    )


def vector_close_check(stored: DataFrame, source: DataFrame, key: str, column: str, eps: float = 1e-6) -> DataFrame:
    """Keys whose vectors differ by more than ``eps`` in some element or in length, or that one side lacks."""
    a, b = stored.select(key, F.col(column).alias("a")), source.select(key, F.col(column).alias("b"))
    far = F.exists(F.zip_with("a", "b", lambda x, y: F.coalesce(F.abs(x - y), F.lit(float("inf")))), lambda d: d > eps)
    return a.join(b, key, "full").select(
        key, F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(far, "different").otherwise("close").alias("status")
    )


def neighbour_count_profile(neighbours: DataFrame, queries: DataFrame, keys: list[str], full: int = 10) -> DataFrame:
    """Neighbours per query: queries, those with none and fewer than ``full``, and the distance spread."""
    per_query = queries.select(*keys).distinct().join(
        neighbours.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.sum("distance").alias("s")
        ), keys, "left",
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") == 0).alias("without_neighbours"),
        F.count_if(F.col("n") < full).alias("short_lists"), F.sum("n").alias("neighbours"), F.min("lo").alias("min_distance"),
        F.max("hi").alias("max_distance"), (F.sum("s") / F.sum("n")).alias("mean_distance"),
    )


def report_count_profile(reported: DataFrame) -> DataFrame:
    """Deciles of reported items per user, interpolated; counts repeat, so the sketch input is a short histogram."""
    counts = reported.groupBy("user_id").agg(F.countDistinct("video_id").alias("n"))
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("users"))
    tenths = F.array(*[F.lit(i / 10) for i in range(11)])
    return histogram.agg(F.percentile("n", tenths, F.col("users")).alias("p")).select(F.posexplode("p").alias("decile", "items"))


