"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import collectors as c
from sluice.operators import joins as j
from sluice.operators import lookups as k
from sluice.operators.ordered import positions
from sluice.plans.clauses import cents
from sluice.plans.registry import Tables, plan


@plan("join", """
    SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def join(t: Tables):
    joined = j.join(t.lineitem, t.orders, "l_orderkey", "o_orderkey")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderpriority")


@plan("join_optional_keys", """
    SELECT x.lang, coalesce(x.quality, -1) AS quality, x.n AS documents, y.n AS other_documents
    FROM (SELECT d.lang, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2) x
    JOIN (SELECT d.source, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2) y
    ON x.quality IS NOT DISTINCT FROM y.quality
""")
def join_optional_keys(t: Tables):
    labelled = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    by_lang = labelled.groupBy("lang", "quality").agg(F.count("*").alias("documents"))
    by_source = labelled.groupBy("source", F.col("quality").alias("q")).agg(F.count("*").alias("other_documents"))
    met = j.join(by_lang, by_source, "quality", "q", optional_keys=True)
    return met.select("lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "documents", "other_documents")


@plan("join_prefix", """
    SELECT c_custkey, c_name, n_name AS home_n_name, n_regionkey AS home_n_regionkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def join_prefix(t: Tables):
    joined = j.join(t.customer, t.nation, "c_nationkey", "home_n_nationkey", prefix="home_")
    return joined.select("c_custkey", "c_name", "home_n_name", "home_n_regionkey")


@plan("left_join", """
    SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents,
        coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') AS states
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def left_join(t: Tables):
    into = {"n": c.count(), "cents": c.total(cents("o_totalprice")), "states": c.lexical_concat("o_orderstatus", ",")}
    return j.left_join(t.customer, t.orders, "c_custkey", "o_custkey", into).select("c_custkey", "n", "cents", "states")


@plan("left_join_where", """
    SELECT s_suppkey, s_acctbal, count(l_orderkey) AS n, coalesce(max(l_quantity), 0.0) AS top
    FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_extendedprice > s_acctbal * 8
    GROUP BY s_suppkey, s_acctbal
""")
def left_join_where(t: Tables):
    dear = F.col("l_extendedprice") > F.col("s_acctbal") * 8
    into = {"n": c.count(), "top": c.maximum("l_quantity", default=F.lit(0.0))}
    met = j.left_join(t.supplier, t.lineitem, "s_suppkey", "l_suppkey", into, where=dear, reads=["s_acctbal"])
    return met.select("s_suppkey", "s_acctbal", "n", "top")


def baskets(t: Tables):
    """Parts of each order as a list."""
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))


def bundles(t: Tables):
    """Parts that share brand, type and size as a list."""
    return t.part.groupBy("p_brand", "p_type", "p_size").agg(F.collect_set("p_partkey").alias("bundle"))


BUNDLE = ["p_brand", "p_type", "p_size"]
BASKETS = "(SELECT l_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_orderkey)"
BUNDLES = "(SELECT p_brand, p_type, p_size, list(DISTINCT p_partkey) AS bundle FROM part GROUP BY p_brand, p_type, p_size)"
PAIRED = """(SELECT DISTINCT l_orderkey, p_brand, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@plan("intersection_join", f"SELECT l_orderkey, p_brand, p_type, p_size FROM {PAIRED}")
def intersection_join(t: Tables):
    pairs = j.intersection_join(baskets(t), bundles(t), "parts", "bundle", left_id=["l_orderkey"], right_id=BUNDLE)
    return pairs.select("l_orderkey", "p_brand", "p_type", "p_size")


@plan("intersection_join_sets", f"SELECT l_orderkey, p_brand, p_type, p_size FROM {PAIRED}")
def intersection_join_sets(t: Tables):
    """The same pairs without row identities."""
    return j.intersection_join(baskets(t), bundles(t), "parts", "bundle").select("l_orderkey", *BUNDLE)


@plan("intersection_join_lift", """
    SELECT DISTINCT l_orderkey, p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def intersection_join_lift(t: Tables):
    return j.membership_join(baskets(t), t.part, "parts", "p_partkey").select("l_orderkey", "p_partkey", "p_brand")


@plan("left_intersection_join", f"""
    SELECT b.l_orderkey, count(p.p_size) AS n, coalesce(string_agg(DISTINCT p.p_brand, ',' ORDER BY p.p_brand), '') AS brands
    FROM {BASKETS} b LEFT JOIN (SELECT * FROM {PAIRED} WHERE p_size > 25) p ON b.l_orderkey = p.l_orderkey GROUP BY b.l_orderkey
""")
def left_intersection_join(t: Tables):
    into = {"n": c.count(), "brands": c.lexical_concat("p_brand", ",")}
    met = j.left_intersection_join(
        baskets(t), bundles(t), "parts", "bundle", into, where=F.col("p_size") > 25, left_id=["l_orderkey"], right_id=BUNDLE
    )
    return met.select("l_orderkey", "n", "brands")


# ------------------------------------------------------------------ lookups


@plan("wildcard_lookup_join", """
    WITH rules AS (SELECT p_brand AS brand, CASE WHEN p_size > 10 THEN NULL ELSE p_size END AS size, min(p_partkey) AS priority,
        arg_min(p_type, p_partkey) AS kind FROM part GROUP BY 1, 2
        UNION ALL SELECT NULL, p_size, min(p_partkey) + 100, arg_min(p_type, p_partkey) FROM part WHERE p_size > 40 GROUP BY 2)
    SELECT p.p_partkey, coalesce((SELECT arg_min(kind, priority) FROM rules r
        WHERE (r.brand IS NULL OR r.brand = p.p_brand) AND (r.size IS NULL OR r.size = p.p_size)), 'NONE') AS kind
    FROM part p
""")
def wildcard_lookup_join(t: Tables):
    size = F.when(F.col("p_size") <= 10, F.col("p_size"))
    first = [F.min("p_partkey").alias("priority"), F.min_by("p_type", "p_partkey").alias("kind")]
    branded = t.part.groupBy(F.col("p_brand").alias("brand"), size.alias("size")).agg(*first)
    large = t.part.filter("p_size > 40").groupBy(F.col("p_size").alias("size")).agg(*first)
    large = large.select(F.lit(None).cast("string").alias("brand"), "size", (F.col("priority") + 100).alias("priority"), "kind")
    rules = branded.unionByName(large)
    keys = {"brand": "p_brand", "size": "p_size"}
    found = k.wildcard_lookup_join(t.part, rules, keys, "kind", "priority", "kind", F.lit("NONE"))
    return found.select("p_partkey", "kind")


@plan("asof_lookup", """
    WITH steps AS (SELECT ts AS start, min(event_type) AS value FROM events WHERE value > 60 GROUP BY ts)
    SELECT e.event_id, epoch_us(coalesce(s.start, TIMESTAMP '1970-01-01')) AS since, coalesce(s.value, '') AS current
    FROM events e ASOF LEFT JOIN steps s ON e.ts >= s.start
""")
def asof_lookup(t: Tables):
    steps = t.events.filter("value > 60").groupBy(F.col("ts").alias("start")).agg(F.min("event_type").alias("value"))
    found = k.asof_lookup(t.events, "ts", steps, "start", "value", "current")
    return found.select("event_id", F.unix_micros("current_start").alias("since"), "current")


@plan("asof_lookup_by_key", """
    WITH steps AS (SELECT user_id, ts AS start, min(event_type) AS value FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)
    SELECT e.event_id, epoch_us(coalesce(s.start, TIMESTAMP '1970-01-01')) AS since, coalesce(s.value, '') AS current
    FROM events e ASOF LEFT JOIN steps s ON e.user_id = s.user_id AND e.ts >= s.start
""")
def asof_lookup_by_key(t: Tables):
    marks = t.events.filter(F.col("event_type").isin("signup", "error"))
    steps = marks.groupBy("user_id", F.col("ts").alias("start")).agg(F.min("event_type").alias("value"))
    found = k.asof_lookup(t.events, "ts", steps, "start", "value", "current", by={"user_id": "user_id"})
    return found.select("event_id", F.unix_micros("current_start").alias("since"), "current")


@plan("window_membership", """
    WITH windows AS (SELECT ts AS start, ts + INTERVAL 1 MINUTE * CAST(floor(value) AS INTEGER) AS finish FROM events WHERE event_type = 'error' AND value > 50)
    SELECT e.event_id, EXISTS (SELECT 1 FROM windows w WHERE w.start < e.ts AND e.ts < w.finish) AS inside FROM events e
""")
def window_membership(t: Tables):
    failing = t.events.filter("event_type = 'error' AND value > 50")
    end = F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts"))
    windows = failing.select(F.col("ts").alias("start"), end.alias("end"))
    return k.window_membership(t.events, "ts", windows, "start", "end", "inside").select("event_id", "inside")


@plan("equivalence_match", """
    WITH listed AS (SELECT p_size AS line, p_name AS member, p_brand FROM part),
    classes AS (SELECT DISTINCT line, member FROM listed WHERE line IN (SELECT line FROM (SELECT DISTINCT line, member FROM listed) GROUP BY line HAVING count(*) > 1)),
    last AS (SELECT member, max(line) AS line FROM classes GROUP BY member)
    SELECT p.p_partkey, (p.p_name = p.p_type OR p.p_name = q.p_name OR EXISTS (
        SELECT 1 FROM last l JOIN classes c ON c.line = l.line WHERE l.member = p.p_name AND c.member = q.p_name)) AS same
    FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
""")
def equivalence_match(t: Tables):
    neighbours = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    rows = t.part.join(neighbours, "p_partkey").select("p_partkey", "p_name", "next_name")
    found = k.equivalence_match(rows, "p_name", "next_name", t.part, "p_name", "p_size", "same")
    return found.select("p_partkey", "same")


@plan("string_expand", """
    WITH wide AS (SELECT p_brand AS key, list(DISTINCT p_type) AS kinds FROM part WHERE p_size > 45 GROUP BY p_brand)
    SELECT p.p_partkey, CASE WHEN w.key IS NULL THEN p.p_brand ELSE array_to_string(list_sort(w.kinds), '|') END AS expanded
    FROM part p LEFT JOIN wide w ON p.p_brand = w.key
""")
def string_expand(t: Tables):
    wide = t.part.filter("p_size > 45").groupBy(F.col("p_brand").alias("key")).agg(F.sort_array(F.collect_set("p_type")).alias("kinds"))
    found = k.string_expand(t.part, "p_brand", wide, "key", "kinds", "expanded")
    return found.select("p_partkey", F.array_join("expanded", "|").alias("expanded"))


@plan("fallback_lookup", """
    WITH panels AS (SELECT p_brand AS panel, p_type AS library, p_size AS genome, min(p_partkey) AS file FROM part WHERE p_size > 20 GROUP BY 1, 2, 3
        UNION ALL SELECT 'ALL', p_type, p_size, max(p_partkey) FROM part WHERE p_size > 10 GROUP BY 2, 3)
    SELECT p.p_partkey, coalesce(x.file, g.file, -1) AS file FROM part p
    LEFT JOIN panels x ON x.panel = p.p_brand AND x.library = p.p_type AND x.genome = p.p_size
    LEFT JOIN panels g ON g.panel = 'ALL' AND g.library = p.p_type AND g.genome = p.p_size
""")
def fallback_lookup(t: Tables):
    exact = t.part.filter("p_size > 20").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("file"))
    general = t.part.filter("p_size > 10").groupBy("p_type", "p_size").agg(F.max("p_partkey").alias("file"))
    panels = exact.unionByName(general.withColumn("p_brand", F.lit("ALL")))
    found = k.fallback_lookup(t.part, panels, "p_brand", ["p_type", "p_size"], "file", "file")
    return found.select("p_partkey", F.coalesce("file", F.lit(-1)).alias("file"))


@plan("name_order_lookup", """
    WITH names AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position
        FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT c.c_custkey, coalesce(n.position, 9223372036854775807) AS position
    FROM customer c LEFT JOIN names n ON c.c_nationkey = n.c_nationkey AND c.c_name = n.c_name
""")
def name_order_lookup(t: Tables):
    listed = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_nationkey").alias("genome"), F.col("c_name").alias("label"), "c_custkey")
    listed = positions(listed, ["genome"], "c_custkey", "place").drop("c_custkey")
    found = k.name_order_lookup(t.customer, "c_nationkey", "c_name", listed, "genome", "label", "place", "position")
    return found.select("c_custkey", "position")


@plan("near_collision_pairs", """
    WITH codes AS (SELECT p_brand, p_name AS code, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT a.p_brand, a.code AS code_a, b.code AS code_b,
        CAST(CASE WHEN a.code = b.code THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS n_pairs,
        CAST(levenshtein(a.code, b.code) AS INTEGER) AS distance
    FROM codes a JOIN codes b ON a.p_brand = b.p_brand AND (a.code < b.code OR (a.code = b.code AND a.n > 1))
    WHERE levenshtein(a.code, b.code) < 4
""")
def near_collision_pairs(t: Tables):
    return k.edit_collisions(t.part.select("p_brand", "p_name"), ["p_brand"], "p_name", 4)


@plan("near_collision_pairs_hamming", """
    WITH codes AS (SELECT p_brand, p_name AS code, count(*) AS n FROM part GROUP BY 1, 2),
    pairs AS (SELECT a.p_brand, a.code AS target, b.code AS other,
        CASE WHEN a.code = b.code THEN a.n * (a.n - 1) ELSE a.n * b.n END AS n_pairs,
        greatest(length(a.code) - length(b.code), 0) + hamming(left(a.code, least(length(a.code), length(b.code))),
            left(b.code, least(length(a.code), length(b.code)))) AS distance
        FROM codes a JOIN codes b ON a.p_brand = b.p_brand)
    SELECT p_brand, target, other, CAST(n_pairs AS BIGINT) AS n_pairs, CAST(distance AS INTEGER) AS distance
    FROM pairs WHERE distance < 4 AND n_pairs > 0
""")
def near_collision_pairs_hamming(t: Tables):
    return k.hamming_collisions(t.part.select("p_brand", "p_name"), ["p_brand"], "p_name", 4)


@plan("config_lookup_table", """
    WITH settings AS (SELECT n_name AS key, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS region FROM nation WHERE n_regionkey <> 0)
    SELECT c.c_custkey, coalesce(s.region, 99) AS region FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN settings s ON s.key = n.n_name
""")
def config_lookup_table(t: Tables):
    region = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))
    settings = t.nation.filter("n_regionkey <> 0").select(F.col("n_name").alias("key"), region.alias("region"))
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    found = k.config_lookup(homes, "n_name", settings, "key", {"region": "region"}, {"region": F.lit(99)})
    return found.select("c_custkey", "region")
