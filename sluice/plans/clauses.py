"""Row clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import clauses as q
from sluice.operators import collectors as c
from sluice.plans.registry import Tables, plan
from sluice.semantics import scratch_path
from sluice.sinks.streams import deal, require_once

CENTS = "CAST(round({} * 100) AS BIGINT)"


def cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


@plan("where", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01'
""")
def where(t: Tables):
    kept = q.where(t.orders, (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")))
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@plan("reject", """
    SELECT CASE WHEN value > 100 THEN 'rejected' ELSE 'kept' END AS stream, event_type, count(*) AS n
    FROM events GROUP BY 1, 2
""")
def reject(t: Tables):
    kept, rejected = q.reject(t.events, F.col("value") > 100)
    parts = [d.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("stream", F.lit(s)) for d, s in ((kept, "kept"), (rejected, "rejected"))]
    return parts[0].unionByName(parts[1])


@plan("require", """
    SELECT d.doc_id, d.lang, CASE WHEN l.quality IS NULL THEN 'rejected' ELSE 'kept' END AS stream,
        coalesce(l.quality, -1) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def require(t: Tables):
    labelled = t.documents.select("doc_id", "lang").join(t.labels.withColumnRenamed("quality", "q"), "doc_id", "left")
    kept, rejected = q.require(labelled, "quality", F.col("q"))
    kept = kept.select("doc_id", "lang", F.lit("kept").alias("stream"), "quality")
    return kept.unionByName(rejected.select("doc_id", "lang", F.lit("rejected").alias("stream"), F.lit(-1).alias("quality")))


@plan("reject_once", """
    SELECT CASE WHEN value > 100 THEN 'loud' WHEN event_type = 'error' THEN 'faulty' ELSE 'kept' END AS stream, user_id, count(*) AS n, max(event_id) AS last
    FROM events GROUP BY 1, 2
""")
def reject_once(t: Tables):
    """Three streams from one read of the events and one write."""
    streams = deal(t.events, scratch_path(t.spark, "streams"), {"loud": F.col("value") > 100, "faulty": F.col("event_type") == "error"})
    parts = [d.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).withColumn("stream", F.lit(s)) for s, d in streams.items()]
    return reduce(DataFrame.unionByName, parts)


@plan("require_once", """
    SELECT d.doc_id, d.lang, CASE WHEN l.quality IS NULL THEN 'rejected' ELSE 'kept' END AS stream, coalesce(l.quality, -1) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def require_once_plan(t: Tables):
    labelled = t.documents.select("doc_id", "lang").join(t.labels.withColumnRenamed("quality", "q"), "doc_id", "left")
    kept, rejected = require_once(labelled, "quality", F.col("q"), scratch_path(t.spark, "required"))
    kept = kept.select("doc_id", "lang", F.lit("kept").alias("stream"), "quality")
    return kept.unionByName(rejected.select("doc_id", "lang", F.lit("rejected").alias("stream"), F.lit(-1).alias("quality")))


@plan("let", """
    SELECT l_orderkey, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
        l_returnflag || l_linestatus AS flags
    FROM lineitem
""")
def let(t: Tables):
    return q.let(
        t.lineitem, "l_orderkey", line=F.col("l_linenumber"), price_cents=cents("l_extendedprice"),
        flags=F.concat("l_returnflag", "l_linestatus"),
    )


PART_GANGS = {"look": ["p_brand", "p_type"], "label": ["p_brand", ("p_type", "SMALL"), "p_size"]}


@plan("let_gang", "SELECT p_brand, p_type, p_size * 2 AS double_size FROM part")
def let_gang(t: Tables):
    return q.let_gang(t.part, q.Gangs(**PART_GANGS), "look", double_size=F.col("p_size") * 2)


@plan("let_onlyif", """
    SELECT d.doc_id, l.quality AS grade FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL
""")
def let_onlyif(t: Tables):
    labelled = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return q.let_only_if(labelled, ["doc_id"], grade=F.col("quality"))


@plan("let_univalued", """
    SELECT conv_id, turn, list_distinct(string_split(role, 'st'))[1] AS piece FROM conversations
    WHERE len(list_distinct(string_split(role, 'st'))) = 1
""")
def let_univalued(t: Tables):
    return q.let_univalued(t.conversations, ["conv_id", "turn"], piece=F.split("role", "st"))


@plan("let_prefix", """
    SELECT a.n_name, b.n_name AS peer_n_name, a.n_regionkey FROM nation a JOIN nation b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def let_prefix(t: Tables):
    peers = q.prefixed(t.nation, "peer_")
    near = (F.col("n_regionkey") == F.col("peer_n_regionkey")) & (F.col("n_nationkey") < F.col("peer_n_nationkey"))
    return t.nation.join(peers, near).select("n_name", "peer_n_name", "n_regionkey")


@plan("flatten", """
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word
""")
def flatten(t: Tables):
    words = q.flatten(t.documents, "word", F.split("text", " "))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@plan("flatten_json", """
    SELECT event_id, unnest([CAST(json_extract(props, '$.k') AS BIGINT), user_id, 7]) AS k FROM events
    WHERE json_extract(props, '$.k') IS NOT NULL
""")
def flatten_json(t: Tables):
    # lists of three numbers; without the first there is no valid list
    items = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("user_id").cast("string"), F.lit(",7]"))
    return q.flatten_json(t.events, "k", items).select("event_id", F.col("k").cast("bigint").alias("k"))


def priority_orders(df, priority: str):
    """A reusable sub-pipeline with a parameter."""
    return df.filter(F.col("o_orderpriority") == priority).select("o_orderkey", "o_orderpriority", "o_custkey")


@plan("define_call", """
    SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def define_call(t: Tables):
    urgent = t.orders.transform(priority_orders, "1-URGENT")
    return urgent.unionByName(t.orders.transform(priority_orders, "2-HIGH"))


@plan("check_guard", """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE (SELECT count(*) FROM customer) > 10
""")
def check_guard(t: Tables):
    checked = q.check_guard(t.orders, t.customer, c.count(), lambda n: n > 10)
    return checked.select("o_orderkey", "o_orderstatus")


@plan("extract_rules", """
    SELECT o_orderkey, o_custkey, 'large' AS rule FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT o_orderkey, o_custkey, 'open' AS rule FROM orders WHERE o_orderstatus = 'O'
""")
def extract_rules(t: Tables):
    return q.extract_rules(t.orders, [
        (F.col("o_totalprice") > 400000, ["o_orderkey", "o_custkey", F.lit("large").alias("rule")]),
        (F.col("o_orderstatus") == "O", ["o_orderkey", "o_custkey", F.lit("open").alias("rule")]),
    ])


@plan("prepared_columns", """
    SELECT p_partkey, p_brand AS brand, p_size AS size FROM part WHERE p_size > 25
""")
def prepared_columns(t: Tables):
    prepared = {"look": [F.col("p_brand").alias("brand"), F.col("p_size").alias("size")]}
    return q.extract_rules(t.part, [(F.col("p_size") > 25, ["p_partkey", "$look"])], prepared)


@plan("destructure", """
    SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_linestatus AS status FROM lineitem
""")
def destructure(t: Tables):
    packed = t.lineitem.select("l_orderkey", "l_linenumber", F.struct("l_returnflag", F.struct("l_linestatus").alias("more")).alias("s"))
    bound = q.destructure(packed, {"flag": "s.l_returnflag", "status": "s.more.l_linestatus"})
    return bound.drop("s")
