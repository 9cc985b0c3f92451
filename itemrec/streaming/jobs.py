"""Structured Streaming forms of the live-history jobs.

Every job is a transformation of a streaming DataFrame; ``run_to_table`` drives one with
exactly-once batch folders. State is keyed by (user, item) wherever possible, so one very active
user is spread over the state partitions. Every state belongs to an event-time window or a
watermark, so it is dropped once no event can reach it any more; events later than the watermark
are dropped too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemrec.functions import rules
from itemrec.runtime import store
from itemrec.streaming.state import PROVIDER

HISTORY_CAP = 500
HISTORY_TTL_DAYS = 60
REPORT_TTL_DAYS = 30


def read_events(spark, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 prepare: Callable[[DataFrame], DataFrame] | None = None, keep_open: bool = False, merge: Callable[[DataFrame], None] | None = None):
    """Write each batch to its own folder, so a replayed batch replaces itself; drains what is available unless kept open.

    With ``merge``, that takes the batch instead; it must bear batches that come again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if merge is not None:
            return merge(batch)
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    if keep_open:
        return writer.trigger(processingTime="1 minute").start()
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


@contextmanager
def state_in_rocksdb(spark) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which map state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version per key of a table written in update mode."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def parsed(events: DataFrame) -> DataFrame:
    """Readable events only: user_id, video_id, percent, publisher_user_id, ts."""
    return events.select("user_id", "ts", rules.parse_event(F.col("event")).alias("e")).where("e.video_id is not null").select(
        "user_id", "e.video_id", F.col("e.percent_watched").alias("mean_percentage_watched"), "e.publisher_user_id", "ts"
    )


def live_history(table: DataFrame, as_of: str, ttl_days: int = HISTORY_TTL_DAYS, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest lists of ``state.live_history`` as they are read at ``as_of``: what has expired since is left out."""
    w = Window.partitionBy("content_type", "user_id").orderBy(F.col("batch").desc())
    newest = table.withColumn("_n", F.dense_rank().over(w)).where("_n = 1 and video_id is not null").drop("_n", "batch", "items")
    since_day = F.lit(as_of).cast("timestamp") - F.expr(f"interval {ttl_days} days")
    return newest.where((F.col("last_watched_timestamp") >= since_day) & (F.col("place") <= cap))


def recent_items(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Items per user in sliding event-time windows."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "user_id", "video_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "user_id", "video_id", "n")
    )


def since(events: DataFrame, start: str, end: str | None = None) -> DataFrame:
    rows = events.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return rows if end is None else rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def dedup(events: DataFrame, ttl: str = f"{HISTORY_TTL_DAYS} days") -> DataFrame:
    """The same item watched again within ``ttl`` counts once."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id", "video_id"])


def view_counts(views: DataFrame, late: str = "1 day") -> DataFrame:
    """Views per item and day, update mode; ``total_views`` adds up the days."""
    return (
        views.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "item_id")
        .agg(F.count_if("logged_in").alias("count_loggedin"), F.count(F.lit(1)).alias("count_all"))
        .select(F.col("window.start").alias("day"), "item_id", "count_loggedin", "count_all")
    )


def total_views(table: DataFrame) -> DataFrame:
    days = latest(table, ["day", "item_id"])
    return days.groupBy("item_id").agg(F.sum("count_loggedin").alias("total_count_loggedin"), F.sum("count_all").alias("total_count_all"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user, emitted once the watermark has passed their end."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )


def report_updates(batch: DataFrame) -> DataFrame:
    """Newest report per (user, item) of a batch."""
    return batch.groupBy("user_id", "video_id").agg(F.max("reported_at").alias("reported_at"))


def merge_reports(batch: DataFrame, path: str, parts: int = 64, days: int = REPORT_TTL_DAYS) -> None:
    """Upsert a batch of reports into the table at ``path``: one row per (user, item), the newest.

    The table lies in ``parts`` folders by user. Only those that the batch touches are read, merged and replaced,
    each by one file, so the number of files stays bounded. Reports that are older than ``days`` before
    the newest of their merge go. The newest report of two wins whatever the order, so a batch that comes again changes nothing.
    """
    spark = batch.sparkSession
    columns = ["user_id", "video_id", "reported_at", "part"]
    fresh = store(report_updates(batch.where("user_id is not null and video_id is not null and reported_at is not null")).withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")))
    touched = [r.part for r in fresh.select("part").distinct().collect()]  # parts at most
    if not touched:
        return
    old = reports_at(spark, path).where(F.col("part").isin(touched))
    rows = old.select(*columns).unionByName(fresh.select(*columns)).groupBy("user_id", "video_id", "part").agg(F.max("reported_at").alias("reported_at"))
    merged = store(rows)  # what is replaced is read before
    newest = merged.agg(F.max("reported_at") - F.expr(f"interval {days} days")).scalar()
    alive = merged.where(F.col("reported_at") >= newest)
    # a part without a living report keeps its files until one comes; ``active_reports`` leaves them out
    alive.repartition(len(touched), "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def reports_at(spark, path: str) -> DataFrame:
    """The table of ``merge_reports``; without rows before its first batch."""
    schema = "user_id string, video_id string, reported_at timestamp, part int"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def active_reports(table: DataFrame, as_of: str, days: int = REPORT_TTL_DAYS) -> DataFrame:
    """Reports that are still alive at ``as_of``."""
    newest = table.groupBy("user_id", "video_id").agg(F.max("reported_at").alias("reported_at"))
    return newest.where(F.col("reported_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def offers_not_watched(offers: DataFrame, history: DataFrame, ttl_days: int = HISTORY_TTL_DAYS, late: str = "10 minutes") -> DataFrame:
    """Offers (user_id, video_id, ts) that the live history (user_id, video_id, ts) has no event for in the ``ttl_days`` before.

    Both are streams. An offer waits in state until both watermarks have passed it and no event that could rule it out
    can come; an event waits until no offer can ask for it. No table is read.
    """
    o = offers.select("user_id", "video_id", "ts").withWatermark("ts", late)
    h = history.select(F.col("user_id").alias("seen_by"), F.col("video_id").alias("seen"), F.col("ts").alias("seen_at")).withWatermark("seen_at", late)
    near = F.expr(f"seen_at <= ts and seen_at >= ts - interval {ttl_days} days")
    same = (F.col("user_id") == F.col("seen_by")) & (F.col("video_id") == F.col("seen"))
    return o.join(h, same & near, "leftOuter").where("seen is null").select("user_id", "video_id", "ts")
