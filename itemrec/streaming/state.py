"""Live history kept in state: one stateful call per user holds the user's items, their cap and their expiry.

Time is event time. A user's timer stands at the moment at which the oldest item is due, so state
shrinks when items expire even if the user never comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = "content_type string, user_id string, video_id string, last_watched_timestamp bigint, mean_percentage_watched double, place int, items int"
STAYS = "user_id string, video_id string, entered bigint, left bigint, events bigint"
_HISTORY, _STAYS = (Row(*[f.split()[0] for f in schema.split(", ")]) for schema in (HISTORY, STAYS))


class _Items(StatefulProcessor):
    """A user's items, and one timer for the next that is due.

    The items are one value, read and written at once: every access to state is a message between Python and the JVM.
    """

    VALUE: tuple[str, ...] = ()

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getValueState("items", ", ".join(["due bigint", "video_id array<string>", *[f"v{i} array<{kind}>" for i, kind in enumerate(self.VALUE)]]))

    def close(self) -> None:
        pass

    def held(self) -> dict[str, tuple]:
        value = self.items.get()
        self.due = value[0] if value else None
        return dict(zip(value[1], zip(*value[2:]))) if value else {}

    def keep(self, before: dict[str, tuple], now: dict[str, tuple], fired: bool = False) -> None:
        """Write what has changed and set the timer for the item that is due first; a timer that has gone off is deleted by Spark."""
        if now == before and not fired:
            return
        # a timer is in milliseconds and goes off once the watermark is past it: never before the item is due
        due = -(-(min(self.seen(v) for v in now.values()) + self.ttl) // 1000) if now else None
        if due != self.due:
            if self.due is not None and not fired:
                self.handle.deleteTimer(self.due)
            if due is not None:
                self.handle.registerTimer(due)
        if now:
            self.items.update((due, list(now), *[list(x) for x in zip(*now.values())]))
        else:
            self.items.clear()

    def seen(self, value: tuple) -> int:
        raise NotImplementedError


class LiveHistory(_Items):
    """The newest ``cap`` items of a (content type, user), each until it hasn't been seen for the ttl.

    Every call that changes something puts out the whole list, which the cap bounds; an empty list is one row without an item.
    """

    VALUE = ("bigint", "double")

    def __init__(self, ttl_micros: int, cap: int):
        super().__init__(ttl_micros)
        self.cap = cap

    def seen(self, value: tuple) -> int:
        return value[0]

    def _list(self, key: tuple, now: dict[str, tuple]) -> Iterator[Row]:
        rows = sorted(now.items(), key=lambda x: (-x[1][0], x[0])) or [(None, (None, None))]
        for place, (video, (last, percent)) in enumerate(rows, 1):
            yield _HISTORY(key[0], key[1], video, last, percent, place, len(now))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held()
        now = dict(before)
        for row in rows:
            percent = row.mean_percentage_watched
            if row.video_id not in now or row.micros > now[row.video_id][0]:
                now[row.video_id] = (row.micros, None if percent is None or percent != percent else float(percent))
        due = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        kept = sorted((video for video, v in now.items() if v[0] >= due), key=lambda x: (-now[x][0], x))[: self.cap]
        now = {video: now[video] for video in kept}
        if now != before:
            self.keep(before, now)
            yield from self._list(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.held()
        due = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        now = {video: v for video, v in before.items() if v[0] > due}
        self.keep(before, now, fired=True)
        if now != before:
            yield from self._list(key, now)


class Stays(_Items):
    """When items enter a user's history and when they leave it, not having been seen for the ttl.

    An entry comes at once, with ``left`` null; the row of the whole stay comes once it is over.
    """

    VALUE = ("bigint", "bigint", "bigint")

    def seen(self, value: tuple) -> int:
        return value[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held()
        now = dict(before)
        for at, video in sorted((row.micros, row.video_id) for row in rows):
            entered, last, n = now.get(video, (None, None, 0))
            if n and at - last > self.ttl:
                yield _STAYS(key[0], video, entered, last + self.ttl, n)
                n = 0
            if not n:
                yield _STAYS(key[0], video, at, None, 1)
                entered, last = at, at
            now[video] = (min(entered, at), max(last, at), n + 1)
        self.keep(before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.held()
        due = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        over = {video: v for video, v in before.items() if v[1] <= due}
        self.keep(before, {video: v for video, v in before.items() if video not in over}, fired=True)
        for video, (entered, last, n) in sorted(over.items()):
            yield _STAYS(key[0], video, entered, last + self.ttl, n)


def _kept(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, late: str, *stamps: str) -> DataFrame:
    rows = events.where("ts is not null and video_id is not null").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    found = rows.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in stamps})


def live_history(events: DataFrame, labels: DataFrame, ttl_days: int, cap: int, late: str = "1 day") -> DataFrame:
    """Lists of ``LiveHistory`` as they change: the newest list of a user is the user's history.

    ``labels`` (video_id, content_type) is a static table; items without a label have no history.
    """
    rows = events.join(labels, "video_id").select("content_type", "user_id", "video_id", "mean_percentage_watched", "ts")
    return _kept(rows, ["content_type", "user_id"], LiveHistory(ttl_days * 86_400_000_000, cap), HISTORY, late, "last_watched_timestamp")


def stays(events: DataFrame, ttl_days: int, late: str = "0 seconds") -> DataFrame:
    """Rows of ``Stays``: (user_id, video_id, entered, left, events)."""
    return _kept(events.select("user_id", "video_id", "ts"), ["user_id"], Stays(ttl_days * 86_400_000_000), STAYS, late, "entered", "left")
