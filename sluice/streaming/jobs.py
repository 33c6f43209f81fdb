"""Streams into the action, alert and snapshot tables.

A micro-batch is reduced first and stored under its own number, so a replayed
batch replaces itself and the stored tables are never rewritten per batch.
Readers fold the batches; folding is the same in any order and any number of
times, so ``compact_*`` may put them into the snapshot at any time, and a batch
that is replayed afterwards is known by its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.sinks.actions import action_scan
from sluice.sinks.alerts import alert_scan
from sluice.sources.snapshots import add_batch, compact, publish, read_batches, read_snapshot
from sluice.streaming.expiry import expired_alerts, with_timers

Batch = Callable[[DataFrame], DataFrame]


def follow(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.parquet", per_batch: int = 1000
) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings while a stream is started; the stream keeps them, the session does not."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(
    stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, every: str | None, mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(consume).outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_rerun(
    stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 minutes"
) -> StreamingQuery:
    """Run a pipeline with idempotent sinks for every micro-batch (and its number)."""
    return _start(stream, run, checkpoint, every)


def stream_actions(
    stream: DataFrame, to_actions: Batch, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Actions of every micro-batch; read the table with ``action_scan``."""
    return _start(stream, lambda batch, n: add_batch(to_actions(batch), table, n), checkpoint, every)


def stream_new_actions(
    rows: DataFrame, merge: Batch, delay: str, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Actions of a stream of ``action_rows``, each stored once while it is repeated.

    A row whose action and tag came before, within ``delay`` of event time, stops
    at the state of the stream, so what is written grows with new actions and
    not with rows.  The state is dropped when the watermark has passed.  An
    action that is repeated for longer is stored again, so its ``last_added`` is
    true to ``delay``; rows that come later than that count as new.
    """
    fresh = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id", "tag"])
    return _start(fresh, lambda batch, n: add_batch(merge(batch), table, n), checkpoint, every)


def stream_alert_expiry(refreshes: DataFrame, delay: str, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """An event whenever an alert of a stream of ``alert_refreshes`` has run out; read them with ``expiry_scan``.

    Events come from timers in the state of the stream, one per label set.  A
    restart goes on with the timers of the last batch, and a batch that is
    replayed stores its events in its own place again.
    """
    with _settings(refreshes.sparkSession, with_timers(refreshes.sparkSession)):
        return _start(expired_alerts(refreshes, delay), lambda batch, n: add_batch(batch, table, n), checkpoint, every)


def expiry_scan(spark: SparkSession, table: str) -> DataFrame:
    """All expiry events, one per episode (a batch may come in while another is compacted)."""
    stored = [d for d in (read_snapshot(spark, table), read_batches(spark, table)) if d is not None]
    if not stored:
        raise FileNotFoundError(table)
    return (stored[0] if len(stored) == 1 else stored[0].unionByName(stored[1])).dropDuplicates(["id", "ends_at"])


def compact_expiry(spark: SparkSession, table: str) -> int | None:
    return compact(spark, table, lambda: expiry_scan(spark, table))


def stream_alerts(
    stream: DataFrame, to_alerts: Batch, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Alerts of every micro-batch; read the table with ``alert_scan``.

    An alert that is not refreshed before its end is no longer live.
    """
    return _start(stream, lambda batch, n: add_batch(to_alerts(batch), table, n), checkpoint, every)


def newest_rows(rows: DataFrame, ids: Sequence[str], newest: str) -> DataFrame:
    """The newest row per id."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    picked = rows.groupBy(*[F.col(i).alias(f"__{i}") for i in ids]).agg(F.max_by(row, F.struct(newest, row)).alias("r"))
    return picked.select("r.*")


def stream_incremental(
    stream: DataFrame, ids: Sequence[str], newest: str, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the newest row per id; read the table with ``incremental_scan``."""
    return _start(stream, lambda batch, n: add_batch(newest_rows(batch, ids, newest), table, n), checkpoint, every)


def incremental_scan(spark: SparkSession, table: str, ids: Sequence[str], newest: str) -> DataFrame:
    stored = [d for d in (read_snapshot(spark, table), read_batches(spark, table)) if d is not None]
    if not stored:
        raise FileNotFoundError(table)
    return newest_rows(stored[0] if len(stored) == 1 else stored[0].unionByName(stored[1]), ids, newest)


def compact_actions(spark: SparkSession, table: str) -> int | None:
    return compact(spark, table, lambda: action_scan(spark, table))


def compact_alerts(spark: SparkSession, table: str) -> int | None:
    return compact(spark, table, lambda: alert_scan(spark, table))


def compact_incremental(spark: SparkSession, table: str, ids: Sequence[str], newest: str) -> int | None:
    return compact(spark, table, lambda: incremental_scan(spark, table, ids, newest))


def stream_group_reemit(grouped: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Publish the whole grouped result again after every micro-batch."""
    return _start(grouped, lambda batch, _: publish(batch, table) and None, checkpoint, every, "complete")


def recent_groups(
    stream: DataFrame, at: str, delay: str, length: str, keys: Sequence[str], values: Sequence[Column]
) -> DataFrame:
    """Groups by a span of event time and keys, kept until the watermark has passed the span.

    Rows of a span that is over are late and are left out; the state holds the
    spans of the last ``delay`` only, however long the stream runs.
    """
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, length).alias("__span"), *keys).agg(*values)
    return grouped.select(F.col("__span.start").alias("span_start"), F.col("__span.end").alias("span_end"), *[c for c in grouped.columns if c != "__span"])


def stream_group_changes(groups: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Publish, after every micro-batch, the groups that it changed; read them with ``group_scan``."""

    def store(batch: DataFrame, n: int) -> None:
        add_batch(batch.withColumn("__batch", F.lit(n).cast("bigint")), table, n)

    return _start(groups, store, checkpoint, every, "update")


def _newest_groups(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    return incremental_scan(spark, table, ["span_start", "span_end", *keys], "__batch")


def group_scan(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """Every group as its last change left it."""
    return _newest_groups(spark, table, keys).drop("__batch")


def compact_groups(spark: SparkSession, table: str, keys: Sequence[str]) -> int | None:
    return compact(spark, table, lambda: _newest_groups(spark, table, keys))
