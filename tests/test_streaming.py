"""Streams fed file by file: late, repeated, out-of-order and broken events."""

import os
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from itemrec.streaming import jobs, state

SCHEMA = "user_id string, video_id string, ts timestamp"


def feed(spark, batches):
    """One file per batch; read back in order, one file per trigger."""
    folder = tempfile.mkdtemp(prefix="stream-in-")
    for rows in batches:
        frame = spark.createDataFrame(rows, "user_id string, video_id string, s double")
        frame.select("user_id", "video_id", F.timestamp_micros((F.col("s") * 1000000).cast("bigint")).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_events(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def drain(spark, stream, mode="append", prepare=None):
    base = tempfile.mkdtemp(prefix="stream-out-")
    with jobs.state_in_rocksdb(spark):
        jobs.run_to_table(stream, base + "/t", base + "/c", mode, prepare)
    return spark.read.parquet(base + "/t")


DAY = 86_400.0


def kept(spark, batches, as_of, ttl_days=60, cap=500, late="1 day"):
    stream = feed(spark, batches).withColumn("mean_percentage_watched", F.unix_seconds("ts") / 100)
    labels = spark.createDataFrame([("a", "clean"), ("b", "clean"), ("c", "nsfw")], "video_id string, content_type string")
    base = tempfile.mkdtemp(prefix="stream-out-")
    with jobs.state_in_rocksdb(spark):
        query = jobs.run_to_table(state.live_history(stream, labels, ttl_days, cap, late), base + "/t", base + "/c", "update")
    rows = jobs.live_history(spark.read.parquet(base + "/t"), as_of, ttl_days, cap).orderBy("content_type", "user_id", "place").collect()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return [(r.content_type, r.video_id, r.last_watched_timestamp.timestamp()) for r in rows], sizes


def test_newest_event_wins_over_batches(spark):
    batches = [[("u", "a", 10.0), ("u", "b", 30.0), ("u", "c", 40.0)], [("u", "a", 50.0), ("u", "b", 5.0), ("u", "unlabelled", 60.0)]]
    assert kept(spark, batches, "1970-01-02 00:00:00")[0] == [("clean", "a", 50.0), ("clean", "b", 30.0), ("nsfw", "c", 40.0)]
    assert kept(spark, batches, "1970-01-02 00:00:00", cap=1)[0] == [("clean", "a", 50.0), ("nsfw", "c", 40.0)]


def test_history_drops_late_and_expired_items(spark):
    batches = [[("u", "a", 1.0)], [("u", "b", 10 * DAY)], [("u", "b", 10 * DAY + 1)], [("u", "a", 2.0)], [("u", "c", 11 * DAY)]]
    assert kept(spark, batches, "1970-01-12 00:00:00", ttl_days=60)[0] == [("clean", "b", 10 * DAY + 1), ("clean", "a", 1.0), ("nsfw", "c", 11 * DAY)]
    assert kept(spark, batches, "1970-01-12 00:00:00", ttl_days=5)[0] == [("clean", "b", 10 * DAY + 1), ("nsfw", "c", 11 * DAY)]


def test_state_shrinks_once_items_expire(spark):
    """Many users' items go when their time is over, though none of those users comes back."""
    batches = [[(f"u{i}", "a", 1.0) for i in range(40)], [("w", "b", 3 * DAY)], [("w", "b", 9 * DAY)], [("w", "b", 10 * DAY)]]
    rows, sizes = kept(spark, batches, "1970-01-11 00:00:00", ttl_days=2)
    assert rows == [("clean", "b", 10 * DAY)]
    assert max(sizes) >= 40 > 5 > sizes[-1]


def test_views_add_up_over_days(spark):
    stream = feed(spark, [[("u", "a", 1.0), ("u", "a", 2.0)], [("w", "a", 3.0), ("w", "a", 3 * DAY)], [("w", "b", 3 * DAY)]])
    table = drain(spark, jobs.view_counts(stream.select(F.col("video_id").alias("item_id"), (F.col("user_id") == "u").alias("logged_in"), "ts")), "update")
    assert sorted(map(tuple, jobs.total_views(table).collect())) == [("a", 2, 4), ("b", 0, 1)]


def test_late_events_are_dropped(spark):
    # a watermark filters late rows from the second batch after it was reached
    stream = feed(spark, [[("u", "a", 1.0)], [("u", "b", 100_000.0)], [("u", "b2", 100_001.0)], [("u", "late", 10.0)], [("u", "c", 200_000.0)]])
    rows = drain(spark, jobs.sessions(stream, late="1 minute")).collect()
    assert sorted((int(r.session_start.timestamp()), r.events) for r in rows) == [(1, 1), (100_000, 2)]


def test_repeats_inside_the_ttl_count_once(spark):
    stream = feed(spark, [[("u", "a", 0.0), ("u", "a", 1.0)], [("u", "a", 50.0), ("w", "a", 50.0)], [("u", "z", 900.0)], [("u", "z", 1000.0)], [("u", "a", 1100.0)]])
    rows = drain(spark, jobs.dedup(stream, "100 seconds")).groupBy("user_id", "video_id").count().collect()
    assert {(r.user_id, r.video_id): r["count"] for r in rows} == {("u", "a"): 2, ("w", "a"): 1, ("u", "z"): 1}


def test_stays_begin_at_once_and_end_when_an_item_is_not_seen_again(spark):
    stream = feed(spark, [[("u", "a", DAY), ("u", "b", DAY)], [("u", "a", 5 * DAY)], [("w", "x", 12 * DAY)], [("w", "y", 20 * DAY)], [("u", "b", 21 * DAY)]])
    table = drain(spark, state.stays(stream, 10), "update")
    day = lambda t: t.timestamp() / DAY
    over = [(r.user_id, r.video_id, day(r.entered), day(r.left), r.events) for r in table.where("left is not null").collect()]
    assert sorted(over) == [("u", "a", 1.0, 15.0, 2), ("u", "b", 1.0, 11.0, 1)]
    begun = sorted((r.user_id, r.video_id, day(r.entered)) for r in table.where("left is null").collect())
    assert begun == [("u", "a", 1.0), ("u", "b", 1.0), ("u", "b", 21.0), ("w", "x", 12.0), ("w", "y", 20.0)]


def test_offers_wait_for_the_history_that_may_rule_them_out(spark):
    offers = feed(spark, [[("u", "a", 10.0), ("u", "b", 10.0), ("w", "a", 10.0)], [("u", "a", 3 * DAY)], [("x", "x", 30 * DAY)]])
    seen = feed(spark, [[("w", "a", 5.0)], [("u", "b", 8.0), ("u", "a", 20.0)], [("y", "y", 30 * DAY)]])
    rows = drain(spark, jobs.offers_not_watched(offers, seen, ttl_days=1)).collect()
    # u's b and w's a were watched before; a was watched after the first offer, and over a day before the second
    assert sorted((r.user_id, r.video_id, r.ts.timestamp()) for r in rows) == [("u", "a", 10.0), ("u", "a", 3 * DAY)]


def test_replayed_batch_replaces_itself(spark):
    base = tempfile.mkdtemp(prefix="stream-out-")
    for _ in range(2):  # a second run without its checkpoint stands for a replay
        jobs.run_to_table(feed(spark, [[("u", "a", 1.0)], [("u", "b", 2.0)]]), base + "/t", tempfile.mkdtemp(prefix="stream-ck-"))
    assert spark.read.parquet(base + "/t").count() == 2


def reports(spark, batches, path, checkpoint=None):
    stream = feed(spark, batches).withColumnRenamed("ts", "reported_at")
    base = tempfile.mkdtemp(prefix="stream-out-")
    jobs.run_to_table(stream, base + "/b", checkpoint or base + "/c", merge=lambda batch: jobs.merge_reports(batch, path, parts=4))
    return {(r.user_id, r.video_id): r.reported_at.timestamp() / DAY for r in jobs.reports_at(spark, path).collect()}


def test_reports_expire_and_keep_the_newest(spark):
    path = tempfile.mkdtemp(prefix="reports-") + "/t"
    found = reports(spark, [[("u", "a", 0.0), ("u", "b", 20 * DAY)], [("u", "a", 35 * DAY), ("u", "b", 10 * DAY)]], path)
    assert found == {("u", "a"): 35.0, ("u", "b"): 20.0}
    table = jobs.reports_at(spark, path)
    assert sorted(r.video_id for r in jobs.active_reports(table, "1970-02-10 00:00:00").collect()) == ["a", "b"]
    assert sorted(r.video_id for r in jobs.active_reports(table, "1970-02-25 00:00:00").collect()) == ["a"]
    # merged again much later, b goes from the table itself
    assert reports(spark, [[("u", "c", 60 * DAY)]], path) == {("u", "a"): 35.0, ("u", "c"): 60.0}


def test_reports_stay_one_row_each_in_few_files_and_bear_replays(spark):
    path = tempfile.mkdtemp(prefix="reports-") + "/t"
    batches = [[(f"u{i}", f"v{j}", 100.0 * k + i) for i in range(12) for j in range(3) if (i + j + k) % 2] for k in range(10)]
    found = reports(spark, batches, path)
    assert found == {(u, v): max(s for b in batches for x, y, s in b if (x, y) == (u, v)) / DAY for b in batches for u, v, _ in b}
    files = lambda: sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    assert jobs.reports_at(spark, path).count() == len(found) and 0 < len(files()) <= 4
    assert reports(spark, batches[3:5], path) == found and len(files()) <= 4
    assert reports(spark, [[]], path) == found


def test_no_reports_yet(spark):
    assert jobs.reports_at(spark, tempfile.mkdtemp(prefix="reports-") + "/t").collect() == []


class Handle:
    """Counts what a processor asks of its state."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_call_reads_and_writes_its_state_once_however_many_items_there_are():
    for processor, width in ((state.Stays(10), 2), (state.LiveHistory(10, 500), 3)):
        handle = Handle()
        processor.init(handle)
        for call in range(2):
            rows = [Row(video_id=f"v{i}", micros=i + 5 * call, mean_percentage_watched=0.5) for i in range(300)]
            assert len(list(processor.handleInputRows(("u",) * width, iter(rows), handle))) >= (300 if call == 0 else 0)
        assert handle.calls <= 8 and len(handle.timers) == 1 and len(handle.value[1]) == 300
