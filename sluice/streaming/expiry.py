"""Alerts that run out, as events from timers.

The state of a label set is its open episodes: spans of time in which each
refresh came before the last one had run out.  Label sets are dealt by hash to a
fixed number of buckets, and a bucket is what Spark keeps state for: its open
label sets are read and written as one list per batch, and it has one event-time
timer, at the first end.  So calls from the task to the store grow with buckets,
not with label sets or episodes.  A refresh moves the timer; when the watermark
passes it, every episode of the bucket that has run out by then is closed with
one expiry event, and the timer goes on to the next end.  No row that comes later can touch a
closed episode, since it would be late, so the events of a stream are those of a
batch over the same rows, in whatever order and however divided they came.
State is held only for label sets with an open episode.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluice.semantics import travels

travels(__name__)

#: Keys of the state; a batch with rows or ends for a bucket rewrites the open label sets of that bucket.
BUCKETS = 1 << 14

EVENTS = "id string, labels string, starts bigint, ends bigint"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Episodes of refreshes: a span that begins before the one before has run out goes on with it."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _timer(end: int) -> int:
    """The millisecond in which a microsecond lies, or the next."""
    return -(-end // 1000)


class Expiry(StatefulProcessor):
    """One key per bucket of label sets; rows are (id, labels, at, ends) in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id string, labels string, spans string")

    def _read(self) -> dict[str, tuple[str, list[tuple[int, int]]]]:
        return {i: (labels, [tuple(map(int, s.split(":"))) for s in spans.split(",")]) for i, labels, spans in self.open.get()}

    @staticmethod
    def _next(held: dict[str, tuple[str, list[tuple[int, int]]]]) -> int | None:
        # episodes of a label set do not overlap, so its first one ends first
        return min((_timer(spans[0][1]) for _, spans in held.values()), default=None)

    def _keep(self, held: dict[str, tuple[str, list[tuple[int, int]]]]) -> None:
        if held:
            self.open.put([(i, labels, ",".join(f"{a}:{b}" for a, b in spans)) for i, (labels, spans) in held.items()])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, new = self._read(), {}
        before = self._next(held)
        for row in rows:
            _, spans = new.setdefault(row.id, (row.labels, []))
            spans.append((row.at, row.ends))
            if len(spans) % 10_000 == 0:
                # a label set holds at most its own episodes and so many refreshes
                spans[:] = merged(spans)
        for i, (labels, spans) in new.items():
            held[i] = labels, merged([*held.get(i, (labels, []))[1], *spans])
        after = self._next(held)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over, rest = [], {}
        for i, (labels, spans) in self._read().items():
            n = sum(_timer(end) <= now for _, end in spans)
            over += [Row(id=i, labels=labels, starts=start, ends=end) for start, end in spans[:n]]
            if spans[n:]:
                rest[i] = labels, spans[n:]
        self._keep(rest)
        if rest:
            self.handle.registerTimer(self._next(rest))
        yield from over

    def close(self) -> None:
        pass


def expired_alerts(refreshes: DataFrame, delay: str) -> DataFrame:
    """Expiry events of a stream of (id, labels, at, ends_at), rows up to ``delay`` out of order."""
    rows = refreshes.withWatermark("at", delay).select(
        "id", F.to_json("labels").alias("labels"), F.unix_micros("at").alias("at"), F.unix_micros("ends_at").alias("ends"), F.col("at").alias("event_time"),
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    events = rows.groupBy("bucket").transformWithState(Expiry(), EVENTS, "append", "EventTime")
    return events.select("id", "labels", F.timestamp_micros("starts").alias("starts_at"), F.timestamp_micros("ends").alias("ends_at"))


def past_alerts(refreshes: DataFrame, upto: Column) -> DataFrame:
    """The same events of a table: episodes that have run out by a time."""
    by = Window.partitionBy("id").orderBy("at")
    running = F.max("ends_at").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = refreshes.withColumn("__new", F.coalesce((F.col("at") >= running).cast("int"), F.lit(1)))
    episodes = starts.withColumn("__n", F.sum("__new").over(by)).groupBy("id", "__n").agg(
        F.any_value(F.to_json("labels")).alias("labels"), F.min("at").alias("starts_at"), F.max("ends_at").alias("ends_at")
    )
    return episodes.filter(F.col("ends_at") <= upto).select("id", "labels", "starts_at", "ends_at")


def with_timers(spark: SparkSession) -> dict[str, str]:
    """Settings that a stream with timers must be started with."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
