"""Structured Streaming plans: each follows the events until all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.plans.registry import SCHEMAS, Tables, plan
from sluice.plans.sinks import ORIGIN, failures, notice_rows, notices
from sluice.semantics import scratch_path
from sluice.sinks.actions import action_scan, merge_rows
from sluice.sinks.alerts import alert_refreshes, alert_scan, live_alerts
from sluice.sources.snapshots import add_batch, read_batches, read_snapshot
from sluice.streaming import jobs


def followed(t: Tables, name: str = "events"):
    # a pattern stands for a single file as well as for a folder of files
    return jobs.follow(t.spark, f"{t.folder}/{{{name}.parquet}}", SCHEMAS[name])


def _finish(query) -> None:
    query.awaitTermination()


@plan("stream_rerun", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_rerun(t: Tables):
    table = scratch_path(t.spark, "rerun")

    def run(batch, n: int) -> None:
        add_batch(batch.groupBy("event_type").agg(F.count("*").alias("n")), table, n)

    _finish(jobs.stream_rerun(followed(t), run, scratch_path(t.spark, "offsets"), None))
    return read_batches(t.spark, table).groupBy("event_type").agg(F.sum("n").alias("n"))


@plan("stream_actions", """
    SELECT '{"kind":"' || event_type || '","user":' || user_id || '}' AS params, epoch_us(min(ts)) AS created, epoch_us(max(ts)) AS last_added,
        'kind-' || event_type || CASE WHEN max(value) > 100 THEN ',loud' ELSE '' END AS tags
    FROM events GROUP BY event_type, user_id
""")
def stream_actions(t: Tables):
    table = scratch_path(t.spark, "actions")
    _finish(jobs.stream_actions(followed(t), notices, table, scratch_path(t.spark, "offsets")))
    return action_scan(t.spark, table).select(
        "params", F.unix_micros("created").alias("created"), F.unix_micros("last_added").alias("last_added"),
        F.array_join("tags", ",").alias("tags"),
    )


@plan("stream_alerts", """
    SELECT event_type AS kind, user_id, epoch_us(max(ts)) AS refreshed FROM events GROUP BY event_type, user_id, value > 100
    HAVING max(ts) + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-29 12:00:00'
""")
def stream_alerts(t: Tables):
    table = scratch_path(t.spark, "alerts")
    _finish(jobs.stream_alerts(followed(t), failures, table, scratch_path(t.spark, "offsets")))
    live = live_alerts(alert_scan(t.spark, table), F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return live.select(
        F.col("labels")["kind"].alias("kind"), F.col("labels")["user"].cast("bigint").alias("user_id"),
        F.unix_micros("refreshed_at").alias("refreshed"),
    )


@plan("stream_incremental", """
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def stream_incremental(t: Tables):
    table, ids = scratch_path(t.spark, "latest"), ["user_id", "event_type"]
    _finish(jobs.stream_incremental(followed(t), ids, "ts", table, scratch_path(t.spark, "offsets")))
    return jobs.incremental_scan(t.spark, table, ids, "ts").select("user_id", "event_type", "event_id", "value")


@plan("stream_group_reemit", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_group_reemit(t: Tables):
    table = scratch_path(t.spark, "groups")
    grouped = followed(t).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    _finish(jobs.stream_group_reemit(grouped, table, scratch_path(t.spark, "offsets")))
    return read_snapshot(t.spark, table)


@plan("stream_new_actions", """
    SELECT '{"kind":"' || event_type || '","user":' || user_id || '}' AS params, 1 AS stored,
        'kind-' || event_type || CASE WHEN max(value) > 100 THEN ',loud' ELSE '' END AS tags
    FROM events GROUP BY event_type, user_id
""")
def stream_new_actions(t: Tables):
    table = scratch_path(t.spark, "new-actions")
    rows = notice_rows(followed(t))
    _finish(jobs.stream_new_actions(rows, lambda batch: merge_rows(batch, "notify", ORIGIN), "40 days", table, scratch_path(t.spark, "offsets")))
    stored = read_batches(t.spark, table).groupBy("id").agg(F.count("*").cast("int").alias("stored"))
    return action_scan(t.spark, table).join(stored, "id").select("params", "stored", F.array_join("tags", ",").alias("tags"))


@plan("stream_alert_expiry", """
    WITH r AS (
        SELECT event_type AS kind, user_id, value > 100 AS large, ts, ts - lag(ts) OVER (PARTITION BY event_type, user_id, value > 100 ORDER BY ts) AS gap FROM events
    ), e AS (
        SELECT *, sum(CASE WHEN gap < INTERVAL 3600 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY kind, user_id, large ORDER BY ts) AS n FROM r
    ), s AS (
        SELECT kind, user_id, large, min(ts) AS starts_at, max(ts) + INTERVAL 3600 SECOND AS ends_at FROM e GROUP BY kind, user_id, large, n
    )
    SELECT kind, user_id, coalesce(large, false) AS large, epoch_us(starts_at) AS starts_at, epoch_us(ends_at) AS ends_at
    FROM s WHERE epoch_us(ends_at) <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)
""")
def stream_alert_expiry(t: Tables):
    table = scratch_path(t.spark, "expiry")
    labels = {"kind": "event_type", "user": "user_id", "large": F.when(F.col("value") > 100, F.lit("yes"))}
    refreshes = alert_refreshes(followed(t), labels, 3600, "ts", "here")
    _finish(jobs.stream_alert_expiry(refreshes, "10 minutes", table, scratch_path(t.spark, "offsets")))
    over = jobs.expiry_scan(t.spark, table).withColumn("labels", F.from_json("labels", "map<string,string>"))
    return over.select(
        F.col("labels")["kind"].alias("kind"), F.col("labels")["user"].cast("bigint").alias("user_id"), F.map_contains_key("labels", "large").alias("large"),
        F.unix_micros("starts_at").alias("starts_at"), F.unix_micros("ends_at").alias("ends_at"),
    )


@plan("stream_group_changes", """
    SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, event_type, count(*) AS n, max(value) AS top, count(value) AS valued
    FROM events GROUP BY 1, 2
""")
def stream_group_changes(t: Tables):
    table = scratch_path(t.spark, "changes")
    values = [F.count("*").alias("n"), F.max("value").alias("top"), F.count("value").alias("valued")]
    groups = jobs.recent_groups(followed(t), "ts", "1 hour", "1 hour", ["event_type"], values)
    _finish(jobs.stream_group_changes(groups, table, scratch_path(t.spark, "offsets")))
    return jobs.group_scan(t.spark, table, ["event_type"]).select(F.unix_micros("span_start").alias("hour"), "event_type", "n", "top", "valued")
