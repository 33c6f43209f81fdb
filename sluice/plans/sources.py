"""Input formats, snapshots and provenance."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sluice.plans.registry import Tables, plan
from sluice.plans.sinks import notices
from sluice.semantics import scratch_path
from sluice.sinks.actions import action_scan as read_actions
from sluice.sinks.actions import action_view, upsert_actions
from sluice.sources import declared as s
from sluice.sources.arrays import write_arrays
from sluice.sources.files import string_set_source as line_set
from sluice.sources.files import unix_files
from sluice.sources.provenance import provenance_rows
from sluice.sources.snapshots import incremental_merge as merge_by_id
from sluice.sources.snapshots import read_snapshot
from sluice.sources.snapshots import snapshot_replace as replace_snapshot


@plan("scan_declared", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_declared(t: Tables):
    """Rows written as JSON and read back under the declared schema."""
    path = scratch_path(t.spark, "declared")
    t.orders.write.json(path)
    fmt = s.Format(t.orders.schema)
    return s.scan_declared(t.spark, fmt, path, "jsonl")


@plan("scan_declared_array", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_linestatus FROM lineitem")
def scan_declared_array(t: Tables):
    """Rows written as JSON arrays, one to a file, and read back by byte range."""
    path = scratch_path(t.spark, "arrays")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_linestatus")
    write_arrays(rows, path)
    return s.scan_declared(t.spark, s.Format(rows.schema), path, "json")


ORDER_FILE = json.dumps({
    "timeFormat": "ISO8660_STRING",
    "variables": {
        "o_orderkey": {"type": "i", "signable": True, "gangs": [{"gang": "order", "order": 1, "dropIfDefault": False}]},
        "o_orderstatus": {"type": "s", "signable": True, "gangs": [{"gang": "order", "order": 0, "dropIfDefault": True}]},
        "o_totalprice": {"type": "f", "signable": False, "gangs": []},
        "o_orderdate": {"type": "d", "signable": False, "gangs": []},
        "o_orderpriority": {"type": "qs", "signable": False, "gangs": []},
    },
})


@plan("schema_from_descriptor", """
    SELECT o_orderstatus || '_' || o_orderkey AS gang, o_orderdate, o_totalprice, 'o_orderkey,o_orderstatus' AS signable FROM orders
""")
def schema_from_descriptor(t: Tables):
    fmt = s.schema_from_descriptor(ORDER_FILE)
    rows = s.scan_declared(t.spark, fmt, t.path("orders"), "parquet")
    return rows.select(fmt.gangs.text("order").alias("gang"), "o_orderdate", "o_totalprice", F.lit(",".join(fmt.signable)).alias("signable"))


@plan("time_decode", "SELECT event_id, epoch_us(ts) AS iso, epoch_us(ts) AS secs, epoch_us(ts) // 1000 * 1000 AS millis FROM events")
def time_decode(t: Tables):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    secs = F.unix_micros("ts") / F.lit(1_000_000.0)
    wire = t.events.select("event_id", iso.alias("iso"), secs.alias("secs"), F.unix_millis("ts").alias("millis"))
    return wire.select(
        "event_id", F.unix_micros(s.time_decode("iso", s.ISO)).alias("iso"),
        F.unix_micros(s.time_decode("secs", s.SECONDS)).alias("secs"),
        F.unix_micros(s.time_decode("millis", s.MILLIS)).alias("millis"),
    )


@plan("scan_union", """
    SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
""")
def scan_union(t: Tables):
    customers = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return s.scan_union([customers, suppliers])


@plan("scan_unix_file", """
    WITH files AS (SELECT '/srv/site' || regexp_replace(regexp_replace(url, '^https?:/', ''), '/$', '') AS file, strlen(html) AS size, page_id FROM pages),
    owners AS (SELECT l.file, min(u) AS usr FROM (SELECT '/srv/site' || regexp_replace(regexp_replace(url, '^https?:/', ''), '/$', '') AS file, 'u' || page_id % 7 AS u FROM pages WHERE page_id % 3 > 0) l GROUP BY 1)
    SELECT f.file, f.size, (f.page_id * 1000 + 500) * 1000 AS mtime, 420 AS perms, coalesce(o.usr, '-') AS "user", true AS rest_empty
    FROM files f LEFT JOIN owners o USING (file)
""")
def scan_unix_file(t: Tables):
    """Pages as the listing of a web root, with an owner table that lacks every third file."""
    path = F.concat(F.lit("/srv//site/."), F.regexp_replace("url", "^https?:/", ""))
    listing = t.pages.select(path.alias("file"), F.octet_length("html").alias("size"), (F.col("page_id") + 0.5).alias("mtime"), F.lit("0644").alias("perms"))
    owners = t.pages.filter("page_id % 3 > 0").select(path.alias("file"), F.concat(F.lit("u"), (F.col("page_id") % 7).cast("string")).alias("user"))
    listed = unix_files(listing, owners)
    empty = F.col("group").isNull() & F.col("host").isNull() & F.col("atime").isNull() & F.col("ctime").isNull()
    return listed.select("file", "size", F.unix_micros("mtime").alias("mtime"), "perms", F.coalesce("user", F.lit("-")).alias("user"), empty.alias("rest_empty"))


@plan("snapshot_replace", """
    SELECT o_orderkey, o_orderstatus, true AS first, false AS second FROM orders
""")
def snapshot_replace(t: Tables):
    path = scratch_path(t.spark, "snapshot")
    good = t.orders.select("o_orderkey", "o_orderstatus")
    # a source that cannot be read: a status that is not a number
    bad = good.withColumn("o_orderstatus", F.col("o_orderstatus").cast("int").cast("string"))
    first, second = replace_snapshot(good, path), replace_snapshot(bad, path)
    return read_snapshot(t.spark, path).withColumns({"first": F.lit(first), "second": F.lit(second)})


@plan("incremental_merge", """
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01'
    UNION ALL SELECT o_orderkey, o_totalprice, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01'
""")
def incremental_merge(t: Tables):
    kept = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    old = kept.filter("o_orderdate < timestamp'1998-07-01'")
    new = kept.filter("o_orderdate >= timestamp'1997-07-01'").withColumn("o_orderstatus", F.lit("new"))
    return merge_by_id(old, new, ["o_orderkey"]).drop("o_orderdate")


@plan("provenance_join", """
    SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN o_orderpriority = '5-LOW' THEN 'skipped'
            WHEN l_linestatus <> o_orderstatus THEN 'stale' ELSE 'good' END AS outcome,
        coalesce(l_linestatus <> o_orderstatus, true) AS is_stale
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 50000) ON l_orderkey = o_orderkey
""")
def provenance_join(t: Tables):
    records = t.orders.filter("o_totalprice > 50000").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("version"), (F.col("o_orderpriority") == "5-LOW").alias("skip")
    )
    runs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    rows = provenance_rows(runs, records, ["l_orderkey"], "l_linestatus", "version", "skip")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "outcome", "is_stale")


@plan("action_scan", """
    SELECT 'action:' || upper(sha1('notify' || chr(10) || p)) AS id, 'notify' AS type, 'UNKNOWN' AS state, p AS info, epoch_us(min(ts)) AS created,
        epoch_us(max(ts)) AS generated, 0 AS checked, epoch_us(coalesce(min(ts) FILTER (WHERE event_id % 2 = 0), min(ts))) AS moved, epoch_us(max(ts)) AS changed, 0 AS priority, 10 AS retry,
        'kind-' || event_type || CASE WHEN max(value) > 100 THEN ',loud' ELSE '' END AS tags, 1 AS places, true AS no_external
    FROM (SELECT *, '{"kind":"' || event_type || '","user":' || user_id || '}' AS p FROM events) GROUP BY p, event_type
""")
def action_scan(t: Tables):
    path = scratch_path(t.spark, "actions")
    # added in two halves, the second of which meets known actions
    upsert_actions(path, notices(t.events.filter("event_id % 2 = 0")))
    upsert_actions(path, notices(t.events.filter("event_id % 2 = 1")))
    table = action_view(read_actions(t.spark, path))
    return table.select(
        "id", "type", "state", "info", F.unix_micros("created").alias("created"), F.unix_micros("generated").alias("generated"),
        F.unix_micros("checked").alias("checked"), F.unix_micros("last_state_transition").alias("moved"), F.unix_micros("changed").alias("changed"), "priority", "retry",
        F.array_join("tags", ",").alias("tags"), F.size("locations").alias("places"), F.col("external_timestamp").isNull().alias("no_external"),
    )


@plan("string_set_source", r"""
    SELECT DISTINCT line AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line <> '' AND NOT starts_with(line, '#')
""")
def string_set_source(t: Tables):
    return line_set(t.documents.select(F.explode(F.split("text", "\n")).alias("value")))


