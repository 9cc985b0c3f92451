"""Streaming jobs, drained over the event table and compared with their batch meaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.catalog.registry import query, sql_view
from itemrec.catalog.scans import scratch
from itemrec.functions import rules
from itemrec.runtime import stored_bytes
from itemrec.sources.views import AS_OF, VIEWS, Tables
from itemrec.streaming import jobs, state

BATCHES = 3
#: Bytes of one file of events, and files of a batch at least.
FILE_BYTES, FILES = 64 << 20, 2


def event_files(t: Tables) -> tuple[str, int]:
    """A copy of the event table in time order, and how many files make a batch: as many as its size needs."""
    base = scratch(t.spark) + "/events"
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / BATCHES
    files = max(FILES, -(-stored_bytes(t.events) // (BATCHES * FILE_BYTES)))
    at = F.coalesce(F.col("ts"), F.lit(first))
    for i in range(BATCHES):
        rows = t.events.where((at >= first + i * step) & (at < first + (i + 1) * step if i + 1 < BATCHES else F.lit(True)))
        rows.repartition(files).write.parquet(f"{base}/{i}")
    return base, files


def event_stream(t: Tables, view: str = "watch_event") -> DataFrame:
    """The same derivation as the batch view, over a stream of the event table in ``BATCHES`` batches."""
    folder, files = event_files(t)
    stream = jobs.read_events(t.spark, folder, t.events.schema, files_per_batch=files)
    text = re.sub(r"<epoch\((\w+)\)>", r"unix_seconds(cast(\1 as timestamp))", VIEWS[view])
    return t.spark.sql(text, events=stream)


def drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    base = scratch(t.spark)
    with jobs.state_in_rocksdb(t.spark):
        jobs.run_to_table(stream, base + "/table", base + "/checkpoint", mode)
    return t.spark.read.parquet(base + "/table")


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSS").alias(name)


sql_view("live", "select user_id, item_id as video_id, ts from watch_event where event_id % 101 <> 0")


@query("stream_watch_history", """
    select content_type, user_id, video_id, strftime(last_watched_timestamp, '%Y-%m-%d %H:%M:%S.%g') as last_watched_timestamp, cast(place as int) as place from (
        select *, row_number() over (partition by content_type, user_id order by last_watched_timestamp desc, video_id) as place
        from (select case when is_nsfw then 'nsfw' else 'clean' end as content_type, user_id, video_id, max(ts) as last_watched_timestamp
              from live join item_nsfw using (video_id) where ts >= timestamp '2024-01-31' - interval 20 days group by all)) where place <= 5""")
def stream_watch_history(t):
    labels = t.item_nsfw.select("video_id", rules.content_type(F.col("is_nsfw")).alias("content_type"))
    table = drained(t, state.live_history(jobs.parsed(event_stream(t)), labels, ttl_days=20, cap=5), "update")
    rows = jobs.live_history(table, "2024-01-31", ttl_days=20, cap=5)
    return rows.select("content_type", "user_id", "video_id", stamp("last_watched_timestamp"), "place")


@query("stream_recent_items", """
    select strftime(w, '%Y-%m-%d %H:%M:%S.%g') as window_start, user_id, video_id, count(*) as n from (
        select user_id, video_id, time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as w from live, range(2) r(k)) group by all""")
def stream_recent_items(t):
    table = drained(t, jobs.recent_items(jobs.parsed(event_stream(t))), "update")
    return jobs.latest(table, ["window_start", "user_id", "video_id"]).select(stamp("window_start"), "user_id", "video_id", "n")


@query("stream_since", """
    select user_id, video_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts from live where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20'""")
def stream_since(t):
    table = drained(t, jobs.since(jobs.parsed(event_stream(t)), "2024-01-10", "2024-01-20"))
    return table.select("user_id", "video_id", stamp("ts"))


sql_view("stay", """
    with m as (select user_id, video_id, ts, case when ts - lag(ts) over (partition by user_id, video_id order by ts) <= interval 5 days then 0 else 1 end as fresh from live),
    n as (select user_id, video_id, ts, sum(fresh) over (partition by user_id, video_id order by ts) as s from m)
    select user_id, video_id, min(ts) as entered, max(ts) + interval 5 days as out, count(*) as events from n group by user_id, video_id, s""")


# an item seen again within 5 days is the same entry; the events span 30 days
@query("stream_dedup", "select user_id, video_id, strftime(entered, '%Y-%m-%d %H:%M:%S.%g') as entered from stay")
def stream_dedup(t):
    table = drained(t, state.stays(jobs.parsed(event_stream(t)), ttl_days=5), "update")
    return table.where("left is null").select("user_id", "video_id", stamp("entered"))


@query("stream_view_counts", "select item_id, total_count_loggedin, total_count_all from view_counts")
def stream_view_counts(t):
    return jobs.total_views(drained(t, jobs.view_counts(event_stream(t, "view_event")), "update"))


# a session is out once the watermark, 10 minutes behind the newest event, has passed its end
@query("stream_sessions", """
    with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 10 minutes then 0 else 1 end as fresh from live),
    n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as s from m),
    g as (select user_id, min(ts) as session_start, max(ts) + interval 10 minutes as session_end, count(*) as events from n group by user_id, s)
    select user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%g') as session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S.%g') as session_end, events
    from g where session_end <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from live)""")
def stream_sessions(t):
    table = drained(t, jobs.sessions(jobs.parsed(event_stream(t))))
    return table.select("user_id", stamp("session_start"), stamp("session_end"), "events")


# an offer is out once both watermarks, 10 minutes behind the newest events, have passed it
sql_view("offer_event", "select * from watch_event where event_id % 101 <> 0 and event_id % 2 = 1")
sql_view("seen_event", "select * from watch_event where event_id % 101 <> 0 and event_id % 2 = 0")


@query("stream_filter_watched", """
    select user_id, item_id as video_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts from offer_event o
    where not exists (select 1 from seen_event w where w.user_id = o.user_id and w.item_id = o.item_id and w.ts <= o.ts and w.ts >= o.ts - interval 5 days)
      and ts < (select date_trunc('milliseconds', least(a, b)) - interval 10 minutes from (select max(ts) as a from offer_event), (select max(ts) as b from seen_event))""")
def stream_filter_watched(t):
    """Offered items, and the live history that rules them out, as two streams."""
    events = event_stream(t)
    sides = [jobs.parsed(events.where(F.col("event_id") % 2 == i)) for i in (1, 0)]
    return drained(t, jobs.offers_not_watched(*sides, ttl_days=5)).select("user_id", "video_id", stamp("ts"))


sql_view("dated_report", """
    select concat('u', o_custkey) as user_id, md5(cast(l_partkey as string)) as video_id, cast(l_shipdate as timestamp) as reported_at
    from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'""")


@query("stream_report_update", f"""
    select user_id, video_id, strftime(max(reported_at), '%Y-%m-%d %H:%M:%S.%g') as reported_at from dated_report group by user_id, video_id
    having max(reported_at) >= timestamp '{AS_OF}' - interval 30 days""")
def stream_report_update(t):
    """Streamed lines join the static orders; every batch is merged into the table of reports, which keeps them for 30 days."""
    lines = jobs.read_events(t.spark, t.folder, t.lineitem.schema, "lineitem.parquet").where("l_returnflag = 'R'")
    reports = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("u"), F.col("o_custkey")).alias("user_id"), F.md5(F.col("l_partkey").cast("string")).alias("video_id"),
        F.col("l_shipdate").cast("timestamp").alias("reported_at"),
    )
    base = scratch(t.spark)
    jobs.run_to_table(reports, base + "/batches", base + "/checkpoint", merge=lambda batch: jobs.merge_reports(batch, base + "/table"))
    return jobs.active_reports(jobs.reports_at(t.spark, base + "/table"), AS_OF).select("user_id", "video_id", stamp("reported_at"))


# a stay is over once the watermark, the newest event here, has passed its end
@query("state_ttl", """
    select user_id, video_id, strftime(entered, '%Y-%m-%d %H:%M:%S.%g') as entered, strftime(out, '%Y-%m-%d %H:%M:%S.%g') as out, events
    from stay where out <= (select date_trunc('milliseconds', max(ts)) from live)""")
def state_ttl(t):
    table = drained(t, state.stays(jobs.parsed(event_stream(t)), ttl_days=5), "update").where("left is not null")
    return table.select("user_id", "video_id", stamp("entered"), stamp("left").alias("out"), "events")
