"""Overview statistics on small action tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import overview as o
from sluice.operators import predicates as p


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_crosstab_leaves_out_universal_values(spark):
    df = spark.createDataFrame(
        [("1", "A", ["x", "all"]), ("2", "B", ["y", "all"]), ("3", "A", ["x", "y", "all"]), ("4", "C", ["all"])],
        "id string, state string, tags array<string>",
    )
    assert rows(o.crosstab_counts(df, "state", "tags")) == [("A", "x", 2), ("A", "y", 1), ("B", "y", 1)]
    assert rows(o.crosstab_counts(df, "tags", "state")) == [("A", "x", 2), ("A", "y", 1), ("B", "y", 1)]
    assert rows(o.crosstab_counts(df, "state", F.lit("same"))) == []


def test_crosstab_of_any_size_and_its_display(spark):
    wide = spark.range(90).select(F.col("id").cast("string").alias("a"), (F.col("id") % 25).cast("string").alias("b"))
    counts = o.crosstab_counts(wide, "a", "b")
    assert counts.count() == 90 and o.crosstab_display(counts).count() == 0
    small = o.crosstab_counts(wide.filter("a < 30").withColumn("b", (F.col("a").cast("int") % 20).cast("string")), "a", "b")
    assert o.crosstab_display(small).count() == small.count() == 30


def test_histogram_bounds(spark):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(seconds=s) for s in (0, 59, 60, 119, 150)]
    df = spark.createDataFrame([(t, start + timedelta(seconds=200)) for t in times], "a timestamp, b timestamp")
    found = o.histogram(df, {"a": "a", "b": "b"}, 100).collect()
    # narrow spans use one-minute buckets
    assert {(r.member, r.bucket): r.n for r in found} == {("a", 0): 2, ("a", 1): 2, ("a", 2): 1, ("a", 3): 0, ("b", 0): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 5}
    assert all(r.end_ms - r.start_ms == 60_000 for r in found)
    same = spark.createDataFrame([(start,), (start,)], "a timestamp")
    assert [(r.bucket, r.n) for r in o.histogram(same, {"a": "a"}).collect()] == [(0, 2)]
    assert o.histogram(same.limit(0), {"a": "a"}).count() == 0
    wide = spark.createDataFrame([(start,), (start + timedelta(hours=1),)], "a timestamp")
    assert {r.bucket: r.n for r in o.histogram(wide, {"a": "a"}, 10).collect()} == {0: 1, 9: 1, **{i: 0 for i in range(1, 9)}}


def test_histogram_by_property(spark):
    start = datetime(2024, 1, 1)
    rows = [(start, ["x", "all"]), (start + timedelta(minutes=3), ["y", "all"]), (start, ["all"])]
    df = spark.createDataFrame(rows, "a timestamp, tags array<string>")
    found = {(r.value, r.bucket): r.n for r in o.histogram_by_property(df, {"a": "a"}, "tags").collect()}
    assert found == {("x", 0): 1, ("x", 1): 0, ("x", 2): 0, ("x", 3): 0, ("y", 0): 0, ("y", 1): 0, ("y", 2): 0, ("y", 3): 1}
    assert o.histogram_by_property(df.filter("a > timestamp'2024-01-01 00:01:00'"), {"a": "a"}, "tags").count() == 0


def test_time_bounds_are_inclusive(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at), ("b", None)], "id string, created timestamp")
    moment = F.lit("2024-01-01").cast("timestamp")
    assert [r.id for r in df.filter(p.between("created", moment, moment)).collect()] == ["a"]
    assert [r.id for r in df.filter(p.between("created")).collect()] == ["a"]
    assert [r.id for r in df.filter(p.ago("created", 0, moment)).collect()] == ["a"]


def test_orphans(spark):
    place = "struct<file:string,line:bigint,column:bigint,hash:string>"
    df = spark.createDataFrame(
        [("1", [("f", 1, 1, "h")]), ("2", [("f", 1, 1, "h"), ("g", 2, 1, "h")]), ("3", [("g", 9, 1, "h")])],
        f"id string, locations array<{place}>",
    )
    live = spark.createDataFrame([("g", 2, 1, "h")], "file string, line bigint, column bigint, hash string")
    assert sorted(r.id for r in p.orphaned(df, live).collect()) == ["1", "3"]


def test_sort_puts_missing_keys_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 5), ("d", 5)], "id string, k int")
    assert [r.id for r in o.action_sort(df, "id", "k").collect()] == ["c", "d", "b", "a"]


def test_pages_follow_the_sort(spark):
    df = spark.createDataFrame([(str(i), i % 7 or None) for i in range(100)], "id string, k int")
    whole = [tuple(r) for r in o.action_sort(df, "id", "k").collect()]
    assert [tuple(r) for r in o.action_page(df, "id", "k", 10, 25).collect()] == whole[10:35]
    assert [tuple(r) for r in o.action_page(df, "id", "k", 95, 25).collect()] == whole[95:]
    assert o.action_page(df, "id", skip=100).collect() == []
    with pytest.raises(ValueError, match="a page needs"):
        o.action_page(df, "id", limit=0)
