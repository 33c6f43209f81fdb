"""Sources, snapshots, sinks and streams."""

import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.operators.predicates import Origin
from sluice.semantics import scratch_path
from sluice.sinks import actions as a
from sluice.sinks import alerts as al
from sluice.sinks import dumps, extracts, refills, streams
from sluice.sources import declared, files, folders
from sluice.sources.folders import put_new
from sluice.sources.provenance import provenance_join
from sluice.sources import snapshots as sn
from sluice.sources.snapshots import current_version, publish, read_snapshot, snapshot_replace
from sluice.streaming import jobs

HERE = Origin("a.rules", 1, 2, "h")


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "test")


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [("the_foo_study", "SlowA", 307), ("the_foo_study", "SlowA", 300)], "project string, workflow string, library_size long"
    )


DESCRIPTOR = json.dumps({
    "timeFormat": "MILLIS_NUMERIC",
    "variables": {
        "x": {"type": "i", "signable": True, "gangs": [{"gang": "hello", "order": 0, "dropIfDefault": False}]},
        "y": {"type": "s", "signable": True, "gangs": [{"gang": "hello", "order": 1, "dropIfDefault": False}]},
        "z": {"type": "as", "signable": False, "gangs": []},
        "d": {"type": "d", "signable": False, "gangs": []},
        "v": {"type": "t3iii", "signable": False, "gangs": []},
        "o": {"type": "qi", "signable": False, "gangs": []},
    },
})


def test_declared_json(spark, tmp_path):
    rows = [{"x": 1, "y": "a", "z": ["q", "p", "q"], "d": 1500, "v": {"_0": 1, "_1": 2, "_2": 3}}]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    fmt = declared.schema_from_descriptor(DESCRIPTOR)
    row = declared.scan_declared(spark, fmt, str(tmp_path)).first()
    assert (row.x, row.z, row.d.replace(tzinfo=None), row.v["_2"], row.o) == (1, ["p", "q"], datetime(1970, 1, 1, 0, 0, 1, 500000), 3, None)
    assert fmt.signable == ("x", "y") and fmt.gangs.columns("hello") == ["x", "y"]


def test_bad_source_fails_the_union(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"x": "not a number"}]')
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("x\n3\n")
    fmt = declared.Format(spark.createDataFrame([(1,)], "x long").schema)
    good = declared.scan_declared(spark, fmt, str(tmp_path / "csv"), "csv")
    assert good.collect()[0].x == 3
    bad = declared.scan_declared(spark, fmt, str(tmp_path / "bad.json"))
    with pytest.raises(Exception):
        declared.scan_union([good, bad]).collect()


def test_small_text_tables(spark, tmp_path):
    (tmp_path / "set.txt").write_text("b\n#no\n\na\nb\n")
    assert sorted(r.value for r in files.scan_string_set(spark, str(tmp_path / "set.txt")).collect()) == ["a", "b"]
    (tmp_path / "t.tsv").write_text("# c\na\t*\n*\tx\n")
    assert [tuple(r) for r in files.scan_tab_table(spark, str(tmp_path / "t.tsv"), ["p", "q"]).collect()] == [("a", None), (None, "x")]
    (tmp_path / "e.txt").write_text("k\tz\ty\nsolo\n")
    assert {r.key: r["values"] for r in files.scan_expansions(spark, str(tmp_path / "e.txt")).collect()} == {"k": ["y", "z"], "solo": []}
    (tmp_path / "i.bed").write_text("c1\t5\t9\nc1\t9\t2\nc2\tx\t1\n")
    from sluice.operators.groupers import span_length_by_name

    spans = span_length_by_name(files.scan_intervals(spark, str(tmp_path / "i.bed")), "name", "start", "end")
    assert sorted(map(tuple, spans.collect())) == [("c1", 11), ("c2", 0)]


def test_snapshot_keeps_the_old_one(spark, folder, runs):
    bad = runs.withColumn("project", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception):
        snapshot_replace(bad, folder)
    assert snapshot_replace(runs, folder) and not snapshot_replace(bad, folder)
    assert current_version(spark, folder) == 1 and read_snapshot(spark, folder).count() == 2


def test_provenance_streams(spark):
    runs = spark.createDataFrame([("k1", "v1"), ("k2", "old"), ("k3", "v1"), ("k4", "v1")], "id string, rv string")
    records = spark.createDataFrame([("k1", "v1", False), ("k2", "v2", False), ("k3", "v9", True)], "id string, pv string, skip boolean")
    p = provenance_join(runs, records, ["id"], "rv", "pv", "skip")
    assert [[r.id for r in f.collect()] for f in (p.good, p.stale, p.skipped, p.missing)] == [["k1"], ["k2"], ["k3"], ["k4"]]


def events(spark, *rows):
    return spark.createDataFrame([(u, datetime(2024, 1, 1, h), tag) for u, h, tag in rows], "user string, ts timestamp, tag string")


def emitted(df):
    return a.emit_actions(df, "run", {"user": "user"}, "ts", HERE, F.array("tag"))


def test_actions_merge_and_are_idempotent(spark, folder):
    first, second = events(spark, ("u", 1, "a"), ("u", 3, "b")), events(spark, ("u", 2, "c"), ("w", 5, "a"))
    for batch in (first, second, second):
        a.upsert_actions(folder, emitted(batch))
    rows = {json.loads(r.params)["user"]: r for r in a.action_scan(spark, folder).collect()}
    assert len(rows) == 2 and rows["u"].tags == ["a", "b", "c"] and rows["u"].state == "UNKNOWN"
    assert rows["u"].created.hour == 1 and rows["u"].last_added.hour == 3 and len(rows["u"].locations) == 1


def test_action_state_is_kept(spark, folder):
    publish(emitted(events(spark, ("u", 1, "a"))).withColumn("state", F.lit("SUCCEEDED")), folder)
    a.upsert_actions(folder, emitted(events(spark, ("u", 9, "z"))))
    row = a.action_scan(spark, folder).first()
    assert (row.state, row.last_added.hour, row.tags) == ("SUCCEEDED", 9, ["a", "z"])


def test_optional_parameter_is_part_of_the_identity_only_when_present(spark):
    df = events(spark, ("u", 1, "a"), ("u", 2, None))
    made = a.emit_actions(df, "run", {"user": "user", "tag": "tag"}, "ts", HERE)
    assert sorted(r.params for r in made.collect()) == ['{"tag":"a","user":"u"}', '{"user":"u"}']


def raised(df):
    return al.emit_alerts(df, {"user": "user", "tag": "tag"}, {"note": "ts"}, 3600, "ts", HERE, instance="i")


def test_alerts_refresh_and_expire(spark, folder):
    al.upsert_alerts(folder, raised(events(spark, ("u", 1, "a"), ("w", 1, None))))
    al.upsert_alerts(folder, raised(events(spark, ("u", 4, "a"))))
    rows = {r.labels["user"]: r for r in al.alert_scan(spark, folder).collect()}
    assert rows["u"].starts_at.hour == 1 and rows["u"].ends_at.hour == 5 and "04" in rows["u"].annotations["note"]
    assert "tag" not in rows["w"].labels and rows["w"].labels["instance"] == "i"
    live = al.live_alerts(al.alert_scan(spark, folder), F.lit("2024-01-01 03:00:00").cast("timestamp"))
    assert [r.labels["user"] for r in live.collect()] == ["u"]


def test_refill_only_on_change(spark, folder, runs):
    assert refills.refill_if_changed(runs, folder)
    assert not refills.refill_if_changed(runs.orderBy("library_size"), folder)
    assert not refills.refill_if_changed(runs.union(runs), folder)
    assert refills.refill_if_changed(runs.limit(1), folder)
    assert current_version(spark, folder) == 2


def test_dump_passes_rows(spark, folder, runs):
    assert dumps.dump(runs, folder, name="project", size="library_size").count() == 2
    lines = {r.value for r in spark.read.text(folder).collect()}
    assert lines == {"name\tsize", "the_foo_study\t307", "the_foo_study\t300"}


def test_flow_counts_are_observed(spark, folder, runs):
    flow = dumps.Flow()
    seen = flow.stage(flow.stage(runs, "in").filter("library_size > 300"), "large")
    seen.write.parquet(folder)
    assert flow.report() == {"in": 2, "large": 1}


def test_extract_formats(spark, runs):
    df = runs.select("project", "library_size").withColumn("at", F.timestamp_millis(F.lit(1500)))
    texts = {}
    for fmt in extracts.FORMATS:
        path = scratch_path(spark, "extract")
        extracts.extract(df.coalesce(1), path, fmt)
        texts[fmt] = [r.value for r in spark.read.text(path).collect()]
    assert texts["TSV"] == ["project\tlibrary_size\tat", "the_foo_study\t307\t1970-01-01T00:00:01.500Z", "the_foo_study\t300\t1970-01-01T00:00:01.500Z"]
    assert json.loads(texts["JSON_SECS"][0])["at"] == 1.5 and json.loads(texts["JSON_MILLIS"][0])["at"] == 1500
    assert "<record>" in "".join(texts["XML"]) and "<records>" in "".join(texts["XML"])
    assert texts["CSV_POSTGRESQL"][1].startswith('"the_foo_study","307"')


def test_extract_checks(runs):
    with pytest.raises(ValueError):
        extracts.extract_type_check(runs, "NO_SUCH_FORMAT")
    with pytest.raises(TypeError):
        extracts.extract_type_check(runs.withColumn("v", F.struct("project")), "TSV")
    extracts.extract_type_check(runs.withColumn("v", F.struct("project")), "JSON")


def test_stream_replay_does_not_double(spark, folder):
    source = scratch_path(spark, "source")
    events(spark, ("u", 1, "a"), ("u", 2, "b")).write.parquet(source)
    schema = "user string, ts timestamp, tag string"
    # two runs with separate offsets see the same files twice
    for run in range(2):
        jobs.stream_actions(jobs.follow(spark, source, schema), emitted, folder, f"{folder}-offsets{run}").awaitTermination()
    row = a.action_scan(spark, folder).collect()
    assert len(row) == 1 and row[0].tags == ["a", "b"]


def test_stream_picks_up_new_files(spark, folder):
    source, schema = scratch_path(spark, "source"), "user string, ts timestamp, tag string"
    for rows in ((("u", 1, "a"), ("w", 2, "b")), (("u", 5, "z"),)):
        events(spark, *rows).write.mode("append").parquet(source)
        stream = jobs.follow(spark, source, schema)
        jobs.stream_incremental(stream, ["user"], "ts", folder, f"{folder}-offsets").awaitTermination()
    got = jobs.incremental_scan(spark, folder, ["user"], "ts")
    assert sorted((r.user, r.tag) for r in got.collect()) == [("u", "z"), ("w", "b")]


def test_two_writers_do_not_overwrite_each_other(spark, folder, runs, monkeypatch):
    publish(runs, folder)
    publish(runs.limit(1), folder)
    real, seen = sn._current, []

    def stale(*where):
        """At first what a writer saw that read the log before the second version was there."""
        seen.append(1)
        line = real(*where)
        return line if len(seen) > 1 else type(line)(**{**line.asDict(), "version": 1})

    with monkeypatch.context() as m:
        m.setattr(sn, "_current", stale)
        assert publish(runs.union(runs), folder) == 3
    assert len(seen) == 2 and current_version(spark, folder) == 3 and read_snapshot(spark, folder).count() == 4
    versions = spark.read.schema("version bigint, folder string").json(f"{folder}/current")
    assert sorted(spark.read.parquet(f"{folder}/{r.folder}").count() for r in versions.collect()) == [1, 2, 4]


def test_two_upserts_at_once_lose_no_row(spark, folder, monkeypatch):
    a.upsert_actions(folder, emitted(events(spark, ("old", 1, "x"))))
    real, together, calls = sn._written, threading.Barrier(2, timeout=120), []

    def written(*what):
        done = real(*what)
        calls.append(1)
        if len(calls) <= 2:
            together.wait()  # both have read version 1 and written their data before either is named
        return done

    monkeypatch.setattr(sn, "_written", written)
    new = [emitted(events(spark, (user, 2, "y"))) for user in ("one", "two")]
    with ThreadPoolExecutor(2) as pool:
        versions = sorted(pool.map(lambda df: a.upsert_actions(folder, df), new))
    assert versions == [2, 3] and len(calls) == 3
    assert sorted(json.loads(r.params)["user"] for r in a.action_scan(spark, folder).collect()) == ["old", "one", "two"]
    # the data that lost the race are gone
    data = [p for p in os.listdir(folder.removeprefix("file://")) if p.startswith("v=")]
    assert len(data) == 3


def test_a_writer_gives_up_in_the_end(spark, folder, runs, monkeypatch):
    publish(runs, folder)
    monkeypatch.setattr(sn, "_named", lambda *a: False)
    with pytest.raises(sn.Overtaken):
        sn.update(spark, folder, lambda old: old, tries=2)
    assert read_snapshot(spark, folder).count() == 2


def test_small_files_are_made_once_on_any_file_system(spark, folder):
    assert put_new(spark, f"{folder}/log/1.json", "one") and not put_new(spark, f"{folder}/log/1.json", "two")
    # the way of file systems without links
    for name, made in (("1.json", False), ("2.json", True), ("2.json", False)):
        assert folders._renamed(spark, *folders._system(spark, f"{folder}/log/{name}"), "three") == made
    assert sorted((r.value) for r in spark.read.text(f"{folder}/log").collect()) == ["one", "three"]
    assert [f for f in os.listdir(f"{folder.removeprefix('file://')}/log") if not f.endswith(".crc")] != []
    folders.remove(spark, f"{folder}/log")
    folders.remove(spark, f"{folder}/log")
    assert not os.path.exists(f"{folder.removeprefix('file://')}/log")


def test_expiry_shortens_the_log(spark, folder, runs):
    for _ in range(4):
        publish(runs, folder)
    sn.expire(spark, folder, keep=2)
    plain = folder.removeprefix("file://")
    assert sorted(f for f in os.listdir(f"{plain}/current") if f.endswith(".json")) == [f"{v:020d}.json" for v in (3, 4)]
    assert len([f for f in os.listdir(plain) if f.startswith("v=")]) == 2
    sn.expire(spark, folder, keep=2)
    assert current_version(spark, folder) == 4 and publish(runs, folder) == 5


def test_a_store_can_be_refilled_from_itself(spark, folder, runs):
    refills.refill_table(runs, folder)
    refills.refill_table(read_snapshot(spark, folder).filter("library_size > 300"), folder)
    assert [r.library_size for r in read_snapshot(spark, folder).collect()] == [307]
    refills.refill_table(runs, folder, "json")
    assert read_snapshot(spark, folder).count() == 2


def test_other_errors_do_not_count_as_no_data(spark, folder, runs):
    assert read_snapshot(spark, folder) is None and sn.read_batches(spark, folder) is None
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sn.when_written(lambda: runs.select("no_such_column"))


def test_compaction_and_replay(spark, folder):
    for n, hour in ((0, 1), (1, 2), (1, 3)):  # batch 1 comes twice, and the second writing counts
        sn.add_batch(emitted(events(spark, ("u", hour, f"t{hour}"))), folder, n)
    before = a.action_scan(spark, folder).collect()
    assert [sorted(r.tags) for r in before] == [["t1", "t3"]]
    assert jobs.compact_actions(spark, folder) == 1 and sn.read_batches(spark, folder) is None
    assert a.action_scan(spark, folder).collect() == before
    sn.add_batch(emitted(events(spark, ("u", 2, "late"))), folder, 1)  # replayed after it was compacted
    assert a.action_scan(spark, folder).collect() == before
    sn.add_batch(emitted(events(spark, ("u", 5, "t5"))), folder, 2)
    assert [sorted(r.tags) for r in a.action_scan(spark, folder).collect()] == [["t1", "t3", "t5"]]
    a.upsert_actions(folder, emitted(events(spark, ("w", 5, "x"))))  # keeps what the snapshot holds
    assert jobs.compact_actions(spark, folder) == 3 and jobs.compact_actions(spark, folder) is None
    sn.expire(spark, folder, keep=1)
    assert a.action_scan(spark, folder).count() == 2


def test_alert_fold_takes_one_row(spark, folder):
    at = datetime(2024, 1, 1)
    row = "struct<file:string,line:bigint,column:bigint,hash:string>"
    df = spark.createDataFrame(
        [("i", {"k": "v"}, at, datetime(2024, 1, d), {"n": n}, [], at) for d, n in ((2, "early"), (3, "late"))],
        f"id string, labels map<string,string>, starts_at timestamp, ends_at timestamp, annotations map<string,string>, locations array<{row}>, refreshed_at timestamp",
    )
    for order in (df, df.orderBy("ends_at"), df.orderBy(F.desc("ends_at"))):
        out = al.fold_alerts(order).first()
        assert (out.ends_at, out.annotations) == (datetime(2024, 1, 3), {"n": "late"})


def test_alerts_may_last_for_ever(spark):
    df = spark.createDataFrame([("u", datetime(2024, 1, 1), 3_000_000_000)], "user string, ts timestamp, ttl long")
    out = al.emit_alerts(df, {"user": "user"}, {}, F.col("ttl"), "ts", HERE).select(F.unix_seconds("ends_at") - F.unix_seconds("starts_at"))
    assert out.first()[0] == 3_000_000_000


def test_action_view_has_the_input_names(spark):
    view = a.action_view(emitted(events(spark, ("u", 1, "a"))))
    assert set(view.columns) == {
        "changed", "checked", "created", "generated", "last_state_transition", "external_timestamp", "id", "state", "type", "info", "locations", "priority", "retry", "tags",
    }
    assert tuple(view.select("priority", "retry").first()) == (0, 10)


def test_unix_files(spark):
    listing = spark.createDataFrame([("/a//b/./c", 5, 1.5, "0755"), ("/x", None, None, None)], "file string, size long, mtime double, perms string")
    details = spark.createDataFrame([("/a/b/c", "z"), ("/a/b/c", "b"), ("/x", None)], "file string, user string")
    rows = {r.file: r for r in files.unix_files(listing, details).collect()}
    assert (rows["/a/b/c"].user, rows["/a/b/c"].perms, rows["/a/b/c"].size, rows["/a/b/c"].mtime.microsecond) == ("b", 493, 5, 500000)
    assert rows["/x"].user is None and rows["/x"].perms is None


def test_merge_replaces_rows_with_an_empty_id(spark):
    old, new = spark.createDataFrame([(None, "old"), (1, "old")], "id long, v string"), spark.createDataFrame([(None, "new")], "id long, v string")
    assert sorted((str(r.id), r.v) for r in sn.incremental_merge(old, new, ["id"]).collect()) == [("1", "old"), ("None", "new")]


def test_repeated_records_do_not_multiply_runs(spark):
    runs = spark.createDataFrame([(1, "a")], "k long, rv string")
    records = spark.createDataFrame([(1, "a", False), (1, "b", False)], "k long, v string, skip boolean")
    joined = provenance_join(runs, records, ["k"], "rv", "v", "skip")
    assert (joined.good.count(), joined.stale.count()) == (0, 1)


def test_streams_come_from_one_read_of_the_source(spark, folder):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(counted, "id bigint")
    bad, odd = F.col("id") % 10 == 0, F.col("id") % 2 == 1
    parts = streams.deal(df, folder, {"bad": bad, "odd": odd, "never": F.col("id") < 0})
    assert {n: d.count() for n, d in parts.items()} == {"bad": 100, "odd": 500, "never": 0, "kept": 400}
    assert parts["odd"].agg(F.sum("id")).first()[0] == sum(range(1, 1000, 2))
    assert reads.value == 1000
    with pytest.raises(ValueError):
        streams.deal(df, folder + "2", {"a/b": bad})


def test_rejected_and_drained_rows(spark, folder):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 200)], "id int, v int")
    kept, rejected = streams.reject_once(df, F.col("v") > 100, folder + "a")
    # an unknown condition does not reject
    assert sorted(r.id for r in kept.collect()) == [1, 2] and [r.id for r in rejected.collect()] == [3]
    bound, empty = streams.require_once(df, "w", F.col("v") * 2, folder + "b")
    assert sorted((r.id, r.w) for r in bound.collect()) == [(1, 10), (3, 400)]
    assert empty.columns == ["id", "v"] and [r.id for r in empty.collect()] == [2]
    taken, stay = streams.drain_once(df, F.col("id") < 3, folder + "c")
    assert taken.count() == 2 and [r.id for r in stay.collect()] == [3]
