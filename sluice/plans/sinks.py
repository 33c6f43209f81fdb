"""Actions, alerts, refills, dumps and extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators.predicates import Origin
from sluice.plans.clauses import cents
from sluice.plans.registry import Tables, plan
from sluice.semantics import scratch_path
from sluice.sinks import actions as a
from sluice.sinks import alerts as al
from sluice.sinks import dumps
from sluice.sinks import refills as r
from sluice.sinks.extracts import extract, extract_type_check, encoded_times
from sluice.sources.snapshots import read_snapshot

ORIGIN = Origin("notices.rules", 4, 1, "v1")


def notice_rows(events):
    """A notice per user and kind of event; loud ones carry extra tags."""
    loud = F.when(F.col("value") > 100, F.array(F.lit("loud"))).otherwise(F.array())
    tags = a.tags(F.concat(F.lit("kind-"), "event_type"), lists=(loud,))
    return a.action_rows(events, "notify", {"user": "user_id", "kind": "event_type"}, "ts", tags)


def notices(events):
    return a.merge_rows(notice_rows(events), "notify", ORIGIN)


NOTICE_PARAMS = """'{"kind":"' || event_type || '","user":' || user_id || '}'"""


@plan("emit_actions", f"""
    SELECT 'action:' || upper(sha1('notify' || chr(10) || {NOTICE_PARAMS})) AS id, {NOTICE_PARAMS} AS params,
        epoch_us(min(ts)) AS created, epoch_us(max(ts)) AS last_added, 'UNKNOWN' AS state,
        'kind-' || event_type || CASE WHEN max(value) > 100 THEN ',loud' ELSE '' END AS tags
    FROM events GROUP BY event_type, user_id
""")
def emit_actions(t: Tables):
    return notices(t.events).select(
        "id", "params", F.unix_micros("created").alias("created"), F.unix_micros("last_added").alias("last_added"), "state",
        F.array_join("tags", ",").alias("tags"),
    )


@plan("optional_params", """
    SELECT CASE WHEN p_size > 30 THEN '{"brand":"' || p_brand || '","size":' || p_size || '}' ELSE '{"brand":"' || p_brand || '"}' END AS params,
        epoch_us(to_timestamp(min(p_partkey))) AS created, epoch_us(to_timestamp(max(p_partkey))) AS added
    FROM part GROUP BY 1
""")
def optional_params(t: Tables):
    at = F.timestamp_seconds("p_partkey")
    size = a.optional_param(F.col("p_size") > 30, F.col("p_size"))
    return a.emit_actions(t.part, "stock", {"brand": "p_brand", "size": size}, at, ORIGIN).select(
        "params", F.unix_micros("created").alias("created"), F.unix_micros("last_added").alias("added")
    )


@plan("dynamic_tags", """
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([p_type, 'red'], string_split(p_name, ' ')))), ',') AS tags FROM part
""")
def dynamic_tags(t: Tables):
    tags = a.tags(F.col("p_type"), F.lit("red"), lists=(F.split("p_name", " "),))
    return t.part.select("p_partkey", F.array_join(F.sort_array(tags), ",").alias("tags"))


def failures(events):
    """An alert per kind and user; large values are marked."""
    return al.emit_alerts(
        events, {"kind": "event_type", "user": "user_id", "large": F.when(F.col("value") > 100, F.lit("yes"))},
        {"last": "event_id"}, 3600, "ts", ORIGIN, instance="here",
    )


@plan("emit_alerts", """
    SELECT upper(sha1('instance' || chr(0) || 'here' || chr(0) || 'kind' || chr(0) || event_type || chr(0) ||
            CASE WHEN value > 100 THEN 'large' || chr(0) || 'yes' || chr(0) ELSE '' END || 'user' || chr(0) || user_id || chr(0))) AS id,
        event_type AS kind, value > 100 AS large, epoch_us(min(ts)) AS starts_at, epoch_us(max(ts)) + 3600000000 AS ends_at,
        CAST(arg_max(event_id, ts) AS VARCHAR) AS last
    FROM events GROUP BY event_type, user_id, value > 100
""")
def emit_alerts(t: Tables):
    return failures(t.events).select(
        "id", F.col("labels")["kind"].alias("kind"), F.map_contains_key("labels", "large").alias("large"),
        F.unix_micros("starts_at").alias("starts_at"), F.unix_micros("ends_at").alias("ends_at"),
        F.col("annotations")["last"].alias("last"),
    )


@plan("live_alerts", """
    SELECT event_type AS kind, user_id, max(ts) AS refreshed FROM events GROUP BY event_type, user_id, value > 100
    HAVING max(ts) + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-29 12:00:00'
""")
def live_alerts(t: Tables):
    live = al.live_alerts(failures(t.events), F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return live.select(F.col("labels")["kind"].alias("kind"), F.col("labels")["user"].cast("bigint").alias("user_id"), F.col("refreshed_at").alias("refreshed"))


@plan("refill_table", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def refill_table(t: Tables):
    path = scratch_path(t.spark, "refill")
    r.refill_table(t.orders.select("o_custkey"), path)
    # the second content is made from the first
    r.refill_table(read_snapshot(t.spark, path).groupBy("o_custkey").agg(F.count("*").alias("n")), path)
    return read_snapshot(t.spark, path)


@plan("refill_if_changed", """
    SELECT true AS first, false AS reordered, true AS changed, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    WHERE l_suppkey > 10
""")
def refill_if_changed(t: Tables):
    path = scratch_path(t.spark, "refill")
    pairs = t.lineitem.select("l_partkey", "l_suppkey")
    flags = {
        "first": r.refill_if_changed(pairs, path),
        "reordered": r.refill_if_changed(pairs.distinct(), path),
        "changed": r.refill_if_changed(pairs.filter("l_suppkey > 10").distinct(), path),
    }
    counted = read_snapshot(t.spark, path).agg(F.count("*").alias("n"))
    return counted.withColumns({n: F.lit(v) for n, v in flags.items()})


@plan("refill_dictionary", """
    SELECT l.l_orderkey, l.l_linenumber, coalesce(d.value, -1) AS smallest FROM lineitem l
    LEFT JOIN (SELECT o_orderkey AS key, min(o_custkey) AS value FROM orders GROUP BY 1) d ON d.key = l.l_orderkey + 3
""")
def refill_dictionary(t: Tables):
    path = scratch_path(t.spark, "dictionary")
    r.refill_dictionary(t.orders, "o_orderkey", "o_custkey", path)
    # the last orders have no successor
    found = r.dictionary_lookup(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("l_orderkey") + 3, path, "value")
    return found.select("l_orderkey", "l_linenumber", F.coalesce("value", F.lit(-1)).alias("smallest"))


def _lines(t: Tables, path: str, header: str):
    return t.spark.read.text(path).filter(F.col("value") != header).select(F.col("value").alias("line"))


@plan("dump", """
    SELECT o_orderkey || chr(9) || o_orderpriority || chr(9) || CAST(round(o_totalprice * 100) AS BIGINT) AS line FROM orders
""")
def dump(t: Tables):
    path = scratch_path(t.spark, "dump")
    dumps.dump(t.orders, path, key="o_orderkey", priority="o_orderpriority", cents=cents("o_totalprice"))
    return _lines(t, path, "key\tpriority\tcents")


@plan("dump_all", "SELECT n_name || chr(9) || n_nationkey || chr(9) || n_regionkey || chr(9) || c_custkey AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dump_all(t: Tables):
    path = scratch_path(t.spark, "dump")
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    homes = homes.select("n_nationkey", "n_name", F.col("c_custkey").alias("z_custkey"), "n_regionkey")
    dumps.dump_all(homes, path)
    return _lines(t, path, "n_name\tn_nationkey\tn_regionkey\tz_custkey")


@plan("monitor", "SELECT o_orderstatus AS state, o_orderpriority AS priority, count(*) AS rows FROM orders GROUP BY 1, 2")
def monitor(t: Tables):
    return dumps.monitor_counts(t.orders, state="o_orderstatus", priority="o_orderpriority")


@plan("flow_counts", """
    SELECT 0 AS position, 'input' AS stage, count(*) AS rows FROM lineitem
    UNION ALL SELECT 1, 'returned', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 2, 'bulk', count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 30) FROM lineitem
""")
def flow_counts(t: Tables):
    return dumps.flow_counts(t.lineitem, [("returned", F.col("l_returnflag") == "R"), ("bulk", F.col("l_quantity") > 30)])


def priced(t: Tables):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")


DATE_TEXT = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


@plan("extract_csv", f"""
    SELECT unnest(['CSV_EXCEL', 'CSV_MONGO', 'CSV_RFC4180']) AS dialect, o_orderkey || ',' || o_orderpriority || ',' || o_totalprice || ',' || {DATE_TEXT} AS line FROM orders
    UNION ALL SELECT 'CSV_MYSQL', o_orderkey || chr(9) || o_orderpriority || chr(9) || o_totalprice || chr(9) || {DATE_TEXT} FROM orders
    UNION ALL SELECT 'CSV_POSTGRESQL', '"' || o_orderkey || '","' || o_orderpriority || '","' || o_totalprice || '","' || {DATE_TEXT} || '"' FROM orders
""")
def extract_csv(t: Tables):
    frames = []
    for dialect in ("CSV_EXCEL", "CSV_MONGO", "CSV_MYSQL", "CSV_POSTGRESQL", "CSV_RFC4180"):
        path = scratch_path(t.spark, "extract")
        extract(priced(t), path, dialect)
        lines = t.spark.read.text(path).filter(~F.col("value").contains("o_orderkey"))
        frames.append(lines.select(F.lit(dialect).alias("dialect"), F.col("value").alias("line")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@plan("extract_tsv", f"""
    SELECT unnest(['TSV', 'TSV_MONGO']) AS dialect, o_orderkey || chr(9) || o_orderpriority || chr(9) || o_totalprice || chr(9) || {DATE_TEXT} AS line FROM orders
""")
def extract_tsv(t: Tables):
    frames = []
    for dialect in ("TSV", "TSV_MONGO"):
        path = scratch_path(t.spark, "extract")
        extract(priced(t), path, dialect)
        frames.append(_lines(t, path, "o_orderkey\to_orderpriority\to_totalprice\to_orderdate").withColumn("dialect", F.lit(dialect)))
    return frames[0].unionByName(frames[1])


@plan("extract_json", f"""
    SELECT 'JSON' AS form, '{{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || {DATE_TEXT} || '"}}' AS line FROM orders
    UNION ALL SELECT 'JSON_MILLIS', '{{"o_orderkey":' || o_orderkey || ',"o_orderdate":' || epoch_us(o_orderdate) // 1000 || '}}' FROM orders
    UNION ALL SELECT 'JSON_SECS', '{{"o_orderkey":' || o_orderkey || ',"o_orderdate":' || epoch_us(o_orderdate) // 1000000 || '}}' FROM orders
""")
def extract_json(t: Tables):
    frames = []
    for form in ("JSON", "JSON_MILLIS"):
        path = scratch_path(t.spark, "extract")
        extract(t.orders.select("o_orderkey", "o_orderdate"), path, form)
        frames.append(t.spark.read.text(path).select(F.lit(form).alias("form"), F.col("value").alias("line")))
    # seconds are floating point; these dates are whole ones
    path = scratch_path(t.spark, "extract")
    extract(t.orders.select("o_orderkey", "o_orderdate"), path, "JSON_SECS")
    back = t.spark.read.schema("o_orderkey bigint, o_orderdate double").json(path)
    line = F.concat(F.lit('{"o_orderkey":'), F.col("o_orderkey"), F.lit(',"o_orderdate":'), F.col("o_orderdate").cast("bigint"), F.lit("}"))
    frames.append(back.select(F.lit("JSON_SECS").alias("form"), line.alias("line")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@plan("extract_xml", f"""
    SELECT unnest(['XML', 'XML_MILLIS', 'XML_SECS']) AS form, o_orderkey, o_orderpriority,
        unnest([{DATE_TEXT}, CAST(epoch_us(o_orderdate) // 1000 AS VARCHAR), CAST(epoch_us(o_orderdate) // 1000000 AS VARCHAR)]) AS o_orderdate FROM orders
""")
def extract_xml(t: Tables):
    frames = []
    for form in ("XML", "XML_MILLIS", "XML_SECS"):
        path = scratch_path(t.spark, "extract")
        extract(t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), path, form)
        back = t.spark.read.format("xml").option("rowTag", "record").schema("o_orderkey bigint, o_orderpriority string, o_orderdate string").load(path)
        # seconds are floating point; these dates are whole ones
        date = F.col("o_orderdate").cast("double").cast("bigint").cast("string") if form == "XML_SECS" else F.col("o_orderdate")
        frames.append(back.select(F.lit(form).alias("form"), "o_orderkey", "o_orderpriority", date.alias("o_orderdate")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@plan("extract_xml_text", f"""
    SELECT '<o_orderkey>' || o_orderkey || '</o_orderkey><o_orderpriority>' || o_orderpriority || '</o_orderpriority><o_orderdate>' || {DATE_TEXT} || '</o_orderdate>' AS record FROM orders
""")
def extract_xml_text(t: Tables):
    """The text itself, record by record."""
    path = scratch_path(t.spark, "extract")
    extract(t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), path, "XML")
    records = t.spark.read.option("lineSep", "</record>").text(path).filter(F.col("value").contains("<record>"))
    inner = F.regexp_extract("value", r"(?s)<record>(.*)\z", 1)
    return records.select(F.regexp_replace(inner, r">\s+<|\A\s+|\s+\z", "><").alias("r")).select(F.regexp_replace("r", r"\A><|><\z", "").alias("r")).select(
        F.when(F.col("r").startswith("<"), F.col("r")).otherwise(F.concat(F.lit("<"), "r")).alias("r")
    ).select(F.when(F.col("r").endswith(">"), F.col("r")).otherwise(F.concat("r", F.lit(">"))).alias("record"))


@plan("extract_type_check", """
    SELECT p_partkey, p_name, true AS text_ok, false AS list_ok FROM part
""")
def extract_type_check_plan(t: Tables):
    """Scalar columns pass the check for text formats; a list column does not."""

    def passes(df) -> bool:
        try:
            extract_type_check(df, "TSV")
        except TypeError:
            return False
        return True

    plain = t.part.select("p_partkey", "p_name")
    listed = plain.withColumn("words", F.split("p_name", " "))
    return encoded_times(plain).withColumns({"text_ok": F.lit(passes(plain)), "list_ok": F.lit(passes(listed))})
