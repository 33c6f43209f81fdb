"""Stateful streams: timers, late rows, bounded state, restarts and replays."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators.predicates import Origin
from sluice.semantics import scratch_path
from sluice.sinks.actions import action_rows, action_scan, merge_rows
from sluice.sinks.alerts import alert_refreshes
from sluice.sources.snapshots import read_batches
from sluice.streaming import jobs
from sluice.streaming.expiry import merged, past_alerts

START = datetime(2024, 5, 1)
SCHEMA = "user bigint, ts timestamp, value double"


@pytest.fixture
def source(spark):
    """A folder of events, and a way to add one file of (user, minute, value) to it."""
    path = scratch_path(spark, "source")
    count = iter(range(1000))

    def add(rows):
        made = spark.createDataFrame([(u, START + timedelta(minutes=m), float(v)) for u, m, v in rows], SCHEMA)
        made.coalesce(1).write.parquet(f"{path}/part={next(count):03d}")

    add.path = path
    return add


def followed(spark, source, per_batch=1):
    return jobs.follow(spark, f"{source.path}/*", SCHEMA, per_batch=per_batch)


def minutes(at):
    return (at - START).total_seconds() / 60


def expiries(spark, table):
    return sorted((json.loads(r["labels"])["user"], minutes(r["starts_at"]), minutes(r["ends_at"])) for r in jobs.expiry_scan(spark, table).collect())


def watch(spark, source, table, offsets):
    refreshes = alert_refreshes(followed(spark, source), {"user": "user"}, 600, "ts")
    query = jobs.stream_alert_expiry(refreshes, "5 minutes", table, offsets)
    query.awaitTermination()
    return query


def test_an_alert_runs_out_once_and_a_refresh_moves_its_timer(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(1, 0, 1), (2, 0, 1)])
    watch(spark, source, table, offsets)
    assert expiries(spark, table) == []
    # user 1 is refreshed in time; the watermark (minute 9 - 5) closes nothing yet
    source([(1, 9, 1)])
    watch(spark, source, table, offsets)
    assert expiries(spark, table) == []
    # minute 16: the watermark at 11 closes user 2, which had until 10, but not user 1, which has until 19
    source([(3, 16, 1)])
    watch(spark, source, table, offsets)
    assert expiries(spark, table) == [("2", 0, 10)]
    source([(3, 40, 1)])
    watch(spark, source, table, offsets)
    assert expiries(spark, table) == [("1", 0, 19), ("2", 0, 10), ("3", 16, 26)]
    # nothing new: no event again
    watch(spark, source, table, offsets)
    assert len(expiries(spark, table)) == 3


def test_rows_out_of_order_over_many_batches_and_restarts_equal_the_batch(spark, source):
    rng = random.Random(8)
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    every = []
    for i in range(4):
        # up to 5 minutes out of order, which is the delay of the watermark
        rows = [(rng.randrange(6), 30 * i + rng.randrange(30 if i == 3 else 26) + 4, 1) for _ in range(25)]
        every += rows
        source(rows)
        watch(spark, source, table, offsets)
    df = spark.createDataFrame([(u, START + timedelta(minutes=m), float(v)) for u, m, v in every], SCHEMA)
    upto = START + timedelta(minutes=max(m for _, m, _ in every) - 5)
    whole = past_alerts(alert_refreshes(df, {"user": "user"}, 600, "ts"), F.lit(upto))
    assert expiries(spark, table) == sorted((json.loads(r["labels"])["user"], minutes(r["starts_at"]), minutes(r["ends_at"])) for r in whole.collect())


def test_a_replayed_batch_gives_no_second_event(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(1, 0, 1), (2, 3, 1)])
    source([(3, 60, 1)])
    query = watch(spark, source, table, offsets)
    once = expiries(spark, table)
    assert once == [("1", 0, 10), ("2", 3, 13)]
    # the last batch stored its rows, but its commit was lost
    folder = f"{offsets.removeprefix('file://')}/commits"
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{folder}/{name}"):
            os.remove(f"{folder}/{name}")
    again = watch(spark, source, table, offsets)
    assert [p["batchId"] for p in again.recentProgress][:1] == [last] and query.id == again.id
    assert expiries(spark, table) == once
    jobs.compact_expiry(spark, table)
    assert expiries(spark, table) == once


def test_state_goes_with_its_last_episode(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(u, 0, 1) for u in range(40)])
    source([(99, 100, 1)])
    query = watch(spark, source, table, offsets)
    metrics = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(m["numRegisteredTimers"] for m in metrics) == 41 and sum(m["numDeletedTimers"] for m in metrics) == 40
    assert len(expiries(spark, table)) == 40


def test_the_session_keeps_its_own_settings(spark, source):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source([(1, 0, 1)])
    watch(spark, source, scratch_path(spark, "t"), scratch_path(spark, "o"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_episodes_are_merged_spans():
    assert merged([(5, 9), (0, 4), (3, 6)]) == [(0, 9)]
    # a refresh at the very end comes too late
    assert merged([(0, 4), (4, 8)]) == [(0, 4), (4, 8)]
    assert merged([(0, 10), (1, 3), (2, 12)]) == [(0, 12)] and merged([]) == []


def changes(spark, source, table, offsets):
    groups = jobs.recent_groups(followed(spark, source), "ts", "10 minutes", "10 minutes", ["user"], [F.count("*").alias("n"), F.sum("value").alias("v")])
    query = jobs.stream_group_changes(groups, table, offsets)
    query.awaitTermination()
    return query


def scanned(spark, table):
    return sorted((minutes(r["span_start"]), -1 if r["user"] is None else r["user"], r["n"], r["v"]) for r in jobs.group_scan(spark, table, ["user"]).collect())


def test_only_changed_groups_are_published_again(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(1, 0, 1), (2, 1, 2), (None, 2, 5)])
    source([(1, 3, 10), (3, 12, 1)])
    changes(spark, source, table, offsets)
    assert scanned(spark, table) == [(0, -1, 1, 5.0), (0, 1, 2, 11.0), (0, 2, 1, 2.0), (10, 3, 1, 1.0)]
    stored = sorted((r["__batch"], r["user"] or -1, r["n"]) for r in read_batches(spark, table).collect())
    assert stored == [(0, -1, 1), (0, 1, 1), (0, 2, 1), (1, 1, 2), (1, 3, 1)]


def test_late_rows_are_left_out_and_state_stays_bounded(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    for hour in range(6):
        source([(u, 60 * hour + u % 10, 1) for u in range(20)])
    # minute 9 of the first hour is long over; minute 300 is the last hour's first span, still open at watermark 299
    source([(1, 9, 100), (1, 300, 100)])
    query = changes(spark, source, table, offsets)
    found = scanned(spark, table)
    assert len(found) == 6 * 20
    assert (0, 1, 1, 1.0) in found and (300, 1, 2, 101.0) in found
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert dropped == 1
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 40 and held[-1] <= 20


def test_compacted_groups_go_on(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(1, 0, 1)])
    changes(spark, source, table, offsets)
    jobs.compact_groups(spark, table, ["user"])
    source([(1, 5, 1), (1, 15, 1)])
    changes(spark, source, table, offsets)
    assert scanned(spark, table) == [(0, 1, 2, 2.0), (10, 1, 1, 1.0)]


ORIGIN = Origin("rules", 1)


def collected(spark, source, table, offsets):
    rows = action_rows(followed(spark, source), "notify", {"user": "user"}, "ts", F.array(F.when(F.col("value") > 5, F.lit("loud")).otherwise(F.lit("quiet"))))
    query = jobs.stream_new_actions(rows, lambda b: merge_rows(b, "notify", ORIGIN), "60 minutes", table, offsets)
    query.awaitTermination()
    return query


def test_an_action_repeated_over_many_batches_is_stored_once(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    every = []
    for i in range(5):
        rows = [(u, 5 * i + u, 1) for u in range(4)] + [(0, 5 * i, 9 if i == 3 else 1), (i, 5 * i, 1)]
        every += rows
        source(rows)
    collected(spark, source, table, offsets)
    df = spark.createDataFrame([(u, START + timedelta(minutes=m), float(v)) for u, m, v in every], SCHEMA)
    whole = merge_rows(action_rows(df, "notify", {"user": "user"}, "ts", F.array(F.when(F.col("value") > 5, F.lit("loud")).otherwise(F.lit("quiet")))), "notify", ORIGIN)
    columns = ["id", "type", "params", "state", "tags", "locations", "priority", "retry"]
    assert sorted(map(str, action_scan(spark, table).select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
    stored = read_batches(spark, table).groupBy("params").count().collect()
    # user 0 is stored again for its new tag only
    assert {r["params"]: r["count"] for r in stored} == {f'{{"user":{u}}}': 2 if u == 0 else 1 for u in range(5)}


def test_an_action_is_stored_again_once_the_watermark_has_passed(spark, source):
    table, offsets = scratch_path(spark, "t"), scratch_path(spark, "o")
    source([(1, 0, 1)])
    source([(2, 200, 1)])
    collected(spark, source, table, offsets)
    source([(1, 210, 1)])
    query = collected(spark, source, table, offsets)
    (one,) = action_scan(spark, table).filter("params = '{\"user\":1}'").collect()
    assert minutes(one["created"]) == 0 and minutes(one["last_added"]) == 210
    assert read_batches(spark, table).filter("params = '{\"user\":1}'").count() == 2
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3


def test_a_bucket_has_one_timer_and_few_calls_however_many_episodes():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from sluice.streaming.expiry import Expiry

    calls, state, timers = [], [], set()

    def put(items):
        calls.append("put")
        state[:] = items

    def register(at):
        calls.append("register")
        timers.add(at)

    opened = SimpleNamespace(get=lambda: iter(list(state)), put=put, clear=lambda: put([]))
    expiry = Expiry()
    expiry.init(SimpleNamespace(getListState=lambda *_: opened, registerTimer=register, deleteTimer=timers.remove))
    rows = [Row(id=f"{i % 50}", labels=f"l{i % 50}", at=k * 10_000, ends=k * 10_000 + 5_000) for i in range(50) for k in range(40)]
    assert list(expiry.handleInputRows((3,), iter(rows), None)) == []
    assert sorted(calls) == ["put", "register"] and timers == {5}
    calls.clear()
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 205)
    over = list(expiry.handleExpiredTimer((3,), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: 5)))
    assert sorted((r.id, r.starts, r.ends) for r in over) == sorted((f"{i}", k * 10_000, k * 10_000 + 5_000) for i in range(50) for k in range(21))
    assert sorted(calls) == ["put", "register"] and 215 in timers and len(state) == 50
