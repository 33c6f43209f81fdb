"""Grouping, collectors, picks and sub-groupers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sluice.functions import masks
from sluice.functions.lists import MARKDOWN
from sluice.operators import clauses as q
from sluice.operators import collectors as c
from sluice.operators import groupers as g
from sluice.operators import grouped_lists as gl
from sluice.operators import grouping as grp
from sluice.operators.lookups import edit_collisions
from sluice.plans.clauses import cents
from sluice.plans.registry import Tables, plan


def labelled(t: Tables):
    """Documents with their (often missing) grades."""
    docs = t.documents.select("doc_id", "lang", "source", F.expr("n_chars div 1000").alias("band"))
    return docs.join(t.labels, "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars // 1000 AS band, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"


@plan("group_by", """
    SELECT l_returnflag, l_linestatus, count(*) AS n,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents,
        max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def group_by(t: Tables):
    return grp.group_by(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "n": c.count(), "price_cents": c.total(cents("l_extendedprice")), "last_ship": c.maximum("l_shipdate"),
    })


@plan("group_key_rename", """
    SELECT year(o_orderdate) AS placed, substring(o_orderpriority, 1, 1) AS level, count(*) AS n FROM orders GROUP BY 1, 2
""")
def group_key_rename(t: Tables):
    keys = {"placed": F.year("o_orderdate"), "level": F.substring("o_orderpriority", 1, 1)}
    return grp.group_by(t.orders, keys, {"n": c.count()})


@plan("group_key_onlyif", f"SELECT quality AS grade, count(*) AS n FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY quality")
def group_key_onlyif(t: Tables):
    return grp.group_by(grp.only_if(labelled(t), grade=F.col("quality")), ["grade"], {"n": c.count()})


@plan("group_key_univalued", """
    SELECT list_distinct(string_split(role, 'st'))[1] AS piece, count(*) AS n FROM conversations
    WHERE len(list_distinct(string_split(role, 'st'))) = 1 GROUP BY 1
""")
def group_key_univalued(t: Tables):
    return grp.group_by(grp.single_item(t.conversations, piece=F.split("role", "st")), ["piece"], {"n": c.count()})


@plan("group_key_gang", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def group_key_gang(t: Tables):
    gangs = q.Gangs(look=["p_brand", "p_type"])
    return grp.group_by(t.part, gangs.columns("look"), {"n": c.count()})


@plan("group_common_where", """
    SELECT user_id, count(*) FILTER (WHERE value > 200) AS n,
        coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE value > 200), '') AS kinds
    FROM events GROUP BY user_id
""")
def group_common_where(t: Tables):
    into = {"n": c.count(), "kinds": c.lexical_concat("event_type", ",")}
    return grp.group_by(t.events, ["user_id"], into, where=F.col("value") > 200)


@plan("group_on_reject", """
    SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'accepted' ELSE 'rejected' END AS stream,
        CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE '' END AS flag
    FROM lineitem GROUP BY l_orderkey
""")
def group_on_reject(t: Tables):
    good, bad = grp.group_by_with_rejects(t.lineitem, ["l_orderkey"], {"flag": c.univalued("l_returnflag")})
    good = good.withColumn("stream", F.lit("accepted"))
    return good.unionByName(bad.withColumns({"stream": F.lit("rejected"), "flag": F.lit("")}))


@plan("agg_any", "SELECT user_id, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id")
def agg_any(t: Tables):
    return grp.group_by(t.events, ["user_id"], {"bought": c.any_match(F.col("event_type") == "purchase")})


@plan("agg_all", "SELECT l_orderkey, bool_and(l_quantity > 10) AS bulk FROM lineitem GROUP BY l_orderkey")
def agg_all(t: Tables):
    return grp.group_by(t.lineitem, ["l_orderkey"], {"bulk": c.all_match(F.col("l_quantity") > 10)})


@plan("agg_none", "SELECT l_orderkey, NOT bool_or(l_returnflag = 'R') AS none_returned FROM lineitem GROUP BY l_orderkey")
def agg_none(t: Tables):
    return grp.group_by(t.lineitem, ["l_orderkey"], {"none_returned": c.none_match(F.col("l_returnflag") == "R")})


@plan("agg_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_count(t: Tables):
    return grp.group_by(t.orders, ["o_custkey"], {"n": c.count()})


@plan("agg_partition_count", """
    SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS matched_count,
        count(*) FILTER (WHERE event_type <> 'error') AS not_matched_count
    FROM events GROUP BY user_id
""")
def agg_partition_count(t: Tables):
    counted = grp.group_by(t.events, ["user_id"], {"p": c.partition_count(F.col("event_type") == "error")})
    return counted.select("user_id", "p.*")


@plan("agg_sum", """
    SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey
""")
def agg_sum(t: Tables):
    return grp.group_by(t.lineitem, ["l_suppkey"], {"lines": c.total("l_linenumber"), "quantity": c.total("l_quantity")})


@plan("agg_list", """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey
""")
def agg_list(t: Tables):
    listed = grp.group_by(t.orders, ["o_custkey"], {"priorities": c.listing("o_orderpriority")})
    return listed.select("o_custkey", F.array_join("priorities", "|").alias("priorities"))


@plan("agg_flatten", """
    SELECT lang, source, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS letters
    FROM (SELECT DISTINCT lang, source, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY lang, source
""")
def agg_flatten(t: Tables):
    merged = grp.group_by(t.documents, ["lang", "source"], {"words": c.flattened(F.split("text", " "))})
    letters = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    return merged.select("lang", "source", F.size("words").cast("bigint").alias("words"), letters.alias("letters"))


@plan("agg_dict", """
    SELECT p_brand, string_agg(p_type || '=' || size, ',' ORDER BY p_type) AS smallest
    FROM (SELECT p_brand, p_type, CAST(min(p_size) AS VARCHAR) AS size FROM part GROUP BY p_brand, p_type) GROUP BY p_brand
""")
def agg_dict(t: Tables):
    built = grp.group_by(t.part, ["p_brand"], {"d": c.dictionary("p_type", "p_size")})
    pairs = F.transform(F.sort_array(F.map_entries("d")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return built.select("p_brand", F.array_join(pairs, ",").alias("smallest"))


@plan("agg_lexical_concat", """
    SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id
""")
def agg_lexical_concat(t: Tables):
    return grp.group_by(t.events, ["user_id"], {"kinds": c.lexical_concat("event_type", ", ")})


@plan("agg_max", """
    SELECT lang, max(quality + toxic) AS best FROM (
        SELECT d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    GROUP BY lang HAVING max(quality + toxic) IS NOT NULL
""")
def agg_max(t: Tables):
    return grp.group_by(labelled(t), ["lang"], {"best": c.maximum(F.col("quality") + F.col("toxic"))})


@plan("agg_min", "SELECT l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_suppkey")
def agg_min(t: Tables):
    return grp.group_by(t.lineitem, ["l_suppkey"], {"first_ship": c.minimum("l_shipdate")})


@plan("agg_default", """
    SELECT l_orderkey, greatest(max(l_quantity), 40.0) AS top, least(min(l_quantity), 2.0) AS low,
        coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_linestatus END), '-') AS returned,
        CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'mixed' END AS status
    FROM lineitem GROUP BY l_orderkey
""")
def agg_default(t: Tables):
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))
    return grp.group_by(t.lineitem, ["l_orderkey"], {
        "top": c.maximum("l_quantity", default=F.lit(40.0)),
        "low": c.minimum("l_quantity", default=F.lit(2.0)),
        "returned": c.first(returned, default=F.lit("-")),
        "status": c.univalued("l_linestatus", default=F.lit("mixed")),
    })


@plan("agg_first", """
    SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS opening FROM orders GROUP BY o_custkey
""")
def agg_first(t: Tables):
    order = F.struct("o_orderdate", "o_orderkey")
    return grp.group_by(t.orders, ["o_custkey"], {"opening": c.first("o_orderpriority", order=order)})


@plan("agg_univalued", """
    SELECT l_orderkey, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 1
""")
def agg_univalued(t: Tables):
    return grp.group_by(t.lineitem, ["l_orderkey"], {"status": c.univalued("l_linestatus")})


@plan("agg_where", """
    SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, count(*) AS orders_placed
    FROM orders GROUP BY o_custkey
""")
def agg_where(t: Tables):
    into = {"open_orders": c.where(F.col("o_orderstatus") == "O", c.count()), "orders_placed": c.count()}
    return grp.group_by(t.orders, ["o_custkey"], into)


@plan("agg_object", """
    SELECT l_suppkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_suppkey
""")
def agg_object(t: Tables):
    summary = c.obj(n=c.count(), low=c.minimum("l_quantity"), high=c.maximum("l_quantity"))
    return grp.group_by(t.lineitem, ["l_suppkey"], {"s": summary}).select("l_suppkey", "s.*")


@plan("agg_optional_drop", f"SELECT source, count(quality) AS graded FROM {LABELLED} GROUP BY source")
def agg_optional_drop(t: Tables):
    return grp.group_by(labelled(t), ["source"], {"graded": c.drop_empty(["quality"], c.count())})


@plan("agg_onlyif_all", f"""
    SELECT source, band, coalesce(CASE WHEN count(*) FILTER (WHERE quality IS NULL) = 0 THEN CAST(sum(quality) AS BIGINT) END, -1) AS good
    FROM {LABELLED} GROUP BY source, band
""")
def agg_onlyif_all(t: Tables):
    got = grp.group_by(labelled(t), ["source", "band"], {"good": c.only_if_all(["quality"], c.total("quality"))})
    return got.withColumn("good", F.coalesce("good", F.lit(-1)))


@plan("agg_onlyif_any", f"""
    SELECT source, band, coalesce(CASE WHEN count(quality) > 0 THEN CAST(sum(quality) AS BIGINT) END, -1) AS good
    FROM {LABELLED} GROUP BY source, band
""")
def agg_onlyif_any(t: Tables):
    got = grp.group_by(labelled(t), ["source", "band"], {"good": c.only_if_any(["quality"], c.total("quality"))})
    return got.withColumn("good", F.coalesce("good", F.lit(-1)))


@plan("agg_require_all", f"""
    SELECT source, band, CAST(sum(quality) AS BIGINT) AS good FROM {LABELLED} GROUP BY source, band
    HAVING count(*) FILTER (WHERE quality IS NULL) = 0
""")
def agg_require_all(t: Tables):
    return grp.group_by(labelled(t), ["source", "band"], {"good": c.require_all(["quality"], c.total("quality"))})


@plan("agg_require_any", f"""
    SELECT source, band, CAST(sum(quality) AS BIGINT) AS good FROM {LABELLED} GROUP BY source, band HAVING count(quality) > 0
""")
def agg_require_any(t: Tables):
    return grp.group_by(labelled(t), ["source", "band"], {"good": c.require_any(["quality"], c.total("quality"))})


LINE_TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity"


@plan("pick_max", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_extendedprice DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
        FROM lineitem) WHERE rn = 1
""")
def pick_max(t: Tables):
    picked = grp.pick_max(t.lineitem, "l_extendedprice", ["l_orderkey"], LINE_TIES.split(", "))
    return picked.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")


@plan("pick_min", """
    SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def pick_min(t: Tables):
    picked = grp.pick_min(t.orders, "o_orderdate", ["o_custkey"], ["o_orderkey"])
    return picked.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")


# ----------------------------------------------------------------- groupers


@plan("grouper_always_include", """
    WITH own AS (SELECT l_orderkey, l_linenumber AS group_key, l_quantity FROM lineitem WHERE l_returnflag <> 'R'),
    shared AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'),
    rows AS (SELECT l_orderkey, group_key, l_quantity, false AS is_always FROM own
        UNION ALL SELECT k.l_orderkey, k.group_key, s.l_quantity, true
        FROM (SELECT DISTINCT l_orderkey, group_key FROM own) k JOIN shared s ON k.l_orderkey = s.l_orderkey)
    SELECT l_orderkey, group_key, count(*) AS n, count(*) FILTER (WHERE is_always) AS always, sum(l_quantity) AS quantity
    FROM rows GROUP BY l_orderkey, group_key
""")
def grouper_always_include(t: Tables):
    # a returned line joins every other line's subgroup
    key = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.col("l_linenumber"))
    return g.always_include(t.lineitem, ["l_orderkey"], key, F.lit(-1), {
        "n": c.count(), "always": c.where(F.col("is_always"), c.count()), "quantity": c.total("l_quantity"),
    })


@plan("grouper_combinations", """
    SELECT a.o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order,
        CAST(round(a.o_totalprice * 100) AS BIGINT) + CAST(round(b.o_totalprice * 100) AS BIGINT) AS cents
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
""")
def grouper_combinations(t: Tables):
    orders = t.orders.withColumn("cents", cents("o_totalprice"))
    pairs = g.combinations(orders, ["o_custkey"], 2, "o_orderkey", {
        "first_order": c.minimum("o_orderkey"), "second_order": c.maximum("o_orderkey"), "cents": c.total("cents"),
    })
    return pairs.drop("subgroup")


@plan("grouper_crosstab", """
    WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
    o AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O')
    SELECT coalesce(f.l_orderkey, o.l_orderkey) AS l_orderkey, f.l_linenumber AS f_line, o.l_linenumber AS o_line, f.l_partkey AS f_part, o.l_partkey AS o_part
    FROM f FULL JOIN o ON f.l_orderkey = o.l_orderkey
""")
def grouper_crosstab(t: Tables):
    # orders with lines of one status give subgroups of one line

    def only(status: str, value: str):
        return c.where(F.col("l_linestatus") == status, c.maximum(value, default=F.lit(None).cast("bigint")))

    lines = t.lineitem.withColumn("line", F.col("l_linenumber").cast("bigint"))
    cells = g.crosstab(lines, ["l_orderkey"], "l_linestatus", "l_linenumber", {
        "f_line": only("F", "line"), "o_line": only("O", "line"), "f_part": only("F", "l_partkey"), "o_part": only("O", "l_partkey"),
    })
    return cells.select("l_orderkey", F.col("f_line").cast("int").alias("f_line"), F.col("o_line").cast("int").alias("o_line"), "f_part", "o_part")


@plan("grouper_powerset", """
    WITH rows AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
    sizes AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey),
    subsets AS (SELECT n_regionkey, unnest(range(1, (1 << n) - 1)) AS subgroup FROM sizes)
    SELECT s.n_regionkey, s.subgroup, count(*) AS members, CAST(sum(c.customers) AS BIGINT) AS customers
    FROM subsets s JOIN rows r ON s.n_regionkey = r.n_regionkey AND (s.subgroup >> r.i) & 1 = 1
    JOIN (SELECT n.n_nationkey, count(c_custkey) AS customers FROM nation n LEFT JOIN customer ON c_nationkey = n.n_nationkey GROUP BY 1) c
        ON c.n_nationkey = r.n_nationkey
    GROUP BY s.n_regionkey, s.subgroup
""")
def grouper_powerset(t: Tables):
    per_nation = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    nations = t.nation.join(per_nation, "n_nationkey", "left").fillna(0, ["customers"])
    return g.powerset(nations, ["n_regionkey"], "n_nationkey", {"members": c.count(), "customers": c.total("customers")})


@plan("group_table", """
    WITH rows AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS line FROM nation)
    SELECT n_regionkey, line, '|' || n_nationkey || '|' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END || '|' AS text FROM rows
    UNION ALL SELECT DISTINCT n_regionkey, 0, '|Key|Name|' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 1, '|---|---' FROM nation
""")
def group_table(t: Tables):
    return gl.table_lines(t.nation, ["n_regionkey"], "n_nationkey", {"Key": F.col("n_nationkey"), "Name": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))}, MARKDOWN)


@plan("group_subsample", """
    WITH rows AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    stops AS (SELECT o_custkey, coalesce(min(CASE WHEN i < 5 AND o_totalprice >= 300000 THEN i END), least(5, max(n))) AS stop FROM rows GROUP BY 1),
    placed AS (SELECT r.*, s.stop, r.n - s.stop AS rest FROM rows r JOIN stops s USING (o_custkey))
    SELECT o_custkey, o_orderkey, 0 AS sampled FROM placed WHERE i < stop
    UNION ALL SELECT o_custkey, o_orderkey, 1 FROM placed WHERE i >= stop AND (rest <= 3 OR ((i - stop) % (rest // 3) = 0 AND i - stop < (rest // 3) * 3))
""")
def group_subsample(t: Tables):
    # the first orders of a customer up to a dear one, five at most, then three spread over the others
    sampled = gl.sample_rows(t.orders, ["o_custkey"], "o_orderkey", gl.Take(5, F.col("o_totalprice") < 300000), gl.Spread(3))
    return sampled.select("o_custkey", "o_orderkey", "sampled")


@plan("flowcell_geometry", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN array_to_string(range(1, p_size % 5 + 2), ',') ELSE array_to_string(range(1, p_size % 5 + 2), '|') END AS lanes FROM part
""")
def flowcell_geometry(t: Tables):
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("NovaSeqStandard")).otherwise(F.lit("Other"))
    lanes = masks.flowcell_geometry(F.col("p_size") % 5 + 1, masks.is_workflow_type_joined(kind))
    return t.part.select("p_partkey", F.array_join(F.transform(lanes, lambda s: F.array_join(F.transform(s, lambda n: n.cast("string")), ",")), "|").alias("lanes"))


@plan("bases_mask", """
    SELECT p_partkey, 'Y' || p_size || 'N1,I' || (p_partkey % 9 + 1) || 'N*,Y*' AS packed, p_size + 1 + p_partkey % 9 + 1 AS index_end, 5 AS segments, 2 AS reads FROM part
""")
def bases_mask(t: Tables):
    text = F.concat(F.lit("y"), F.col("p_size"), F.lit("n1, i"), F.col("p_partkey") % 9 + 1, F.lit("n*,y*"))
    parsed = t.part.select("p_partkey", masks.parse_bases_mask(text).alias("s"))
    reads = F.size(F.filter("s", lambda s: s["type"] == "Y"))
    return parsed.select(
        "p_partkey", masks.pack_bases_mask(F.transform("s", masks.convert_mask)).alias("packed"), F.col("s")[2]["cycle_end"].alias("index_end"),
        F.size("s").alias("segments"), reads.alias("reads"),
    )


# group keys that may be empty: the quality of a document, where it was judged

JUDGED = "WITH d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def judged(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@plan("grouper_always_include_optional", f"""
    {JUDGED}, own AS (SELECT lang, quality, n_chars FROM d WHERE quality IS DISTINCT FROM 0),
    shared AS (SELECT lang, n_chars FROM d WHERE quality = 0),
    rows AS (SELECT lang, quality, n_chars FROM own UNION ALL
        SELECT k.lang, k.quality, s.n_chars FROM (SELECT DISTINCT lang, quality FROM own) k JOIN shared s ON k.lang = s.lang)
    SELECT lang, quality AS group_key, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM rows GROUP BY lang, quality
""")
def grouper_always_include_optional(t: Tables):
    # documents of low quality join the subgroup of each other quality, that of the unjudged ones too
    return g.always_include(judged(t), ["lang"], "quality", F.lit(0), {"n": c.count(), "chars": c.total("n_chars")})


@plan("grouper_always_include_optional_group", f"""
    {JUDGED}, own AS (SELECT quality, lang, n_chars FROM d WHERE lang <> 'en'), shared AS (SELECT quality, n_chars FROM d WHERE lang = 'en'),
    rows AS (SELECT quality, lang, n_chars FROM own UNION ALL SELECT k.quality, k.lang, s.n_chars
        FROM (SELECT DISTINCT quality, lang FROM own) k JOIN shared s ON k.quality IS NOT DISTINCT FROM s.quality)
    SELECT quality, lang AS group_key, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM rows GROUP BY quality, lang
""")
def grouper_always_include_optional_group(t: Tables):
    return g.always_include(judged(t), ["quality"], "lang", F.lit("en"), {"n": c.count(), "chars": c.total("n_chars")})


@plan("grouper_combinations_optional", f"""
    {JUDGED}, per AS (SELECT quality, lang, row_number() OVER (PARTITION BY quality ORDER BY lang) AS i, count(*) AS n FROM d GROUP BY quality, lang)
    SELECT a.quality, a.lang AS low, b.lang AS high, a.n + b.n AS n FROM per a JOIN per b ON a.quality IS NOT DISTINCT FROM b.quality AND a.i < b.i
""")
def grouper_combinations_optional(t: Tables):
    per = judged(t).groupBy("quality", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    pairs = g.combinations(per, ["quality"], 2, "first", {"low": c.minimum("lang"), "high": c.maximum("lang"), "n": c.total("n")})
    return pairs.drop("subgroup")


@plan("grouper_crosstab_optional", f"""
    {JUDGED}, per AS (SELECT quality, lang = 'en' AS english, source, count(*) AS n FROM d GROUP BY quality, lang = 'en', source)
    SELECT coalesce(e.quality, f.quality) AS quality, e.source AS english_source, f.source AS other_source, coalesce(e.n, 0) + coalesce(f.n, 0) AS n
    FROM (SELECT *, coalesce(quality, -1) AS q FROM per WHERE english) e FULL JOIN (SELECT *, coalesce(quality, -1) AS q FROM per WHERE NOT english) f ON e.q = f.q
""")
def grouper_crosstab_optional(t: Tables):
    english = judged(t).withColumn("english", F.col("lang") == "en")
    per = english.groupBy("quality", "english", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))

    def only(condition):
        return c.where(condition, c.maximum("source", default=F.lit(None).cast("string")))

    members = {"english_source": only(F.col("english")), "other_source": only(~F.col("english")), "n": c.total("n")}
    return g.crosstab(per, ["quality"], "english", "first", members).drop("subgroup")


@plan("near_collision_pairs_optional", f"""
    {JUDGED}, codes AS (SELECT quality, left(md5(lang || n_chars), 3) AS code FROM d),
    counted AS (SELECT quality, code, count(*) AS n FROM codes GROUP BY 1, 2)
    SELECT a.quality, a.code AS code_a, b.code AS code_b, CASE WHEN a.code = b.code THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs,
        CASE WHEN a.code = b.code THEN 0 ELSE levenshtein(a.code, b.code) END AS distance
    FROM counted a JOIN counted b ON a.quality IS NOT DISTINCT FROM b.quality AND a.code <= b.code
    WHERE levenshtein(a.code, b.code) < 2 AND (a.code <> b.code OR a.n > 1)
""")
def near_collision_pairs_optional(t: Tables):
    codes = judged(t).select("quality", F.substring(F.md5(F.concat(F.col("lang"), F.col("n_chars").cast("string"))), 1, 3).alias("code"))
    return edit_collisions(codes, ["quality"], "code", 2).select("quality", "code_a", "code_b", "n_pairs", "distance")


@plan("grouper_merge_sets_optional", """
    WITH rows AS (SELECT l_linenumber AS lane, l_quantity AS q, CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE l_orderkey END AS run FROM lineitem),
    kept AS (SELECT coalesce(run, -1) AS r, run, lane, q FROM rows),
    lanes AS (SELECT DISTINCT r, lane FROM kept),
    heads AS (SELECT r, lane, CASE WHEN lane % 2 = 0 AND (r, lane - 1) IN (SELECT (r, lane) FROM lanes) THEN lane - 1 ELSE lane END AS head FROM lanes),
    named AS (SELECT r, head, string_agg(CAST(lane AS VARCHAR), '+' ORDER BY lane) AS lanes FROM heads GROUP BY 1, 2)
    SELECT run, lanes, count(*) AS n, sum(q) AS quantity FROM kept JOIN heads USING (r, lane) JOIN named USING (r, head) GROUP BY run, lanes
""")
def grouper_merge_sets_optional(t: Tables):
    pairs = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in lanes]) for lanes in ((1, 2), (3, 4), (5, 6), (7, 8))])
    lines = t.lineitem.select(
        F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey")).alias("run"), F.col("l_linenumber").cast("bigint").alias("lane"), "l_quantity",
        F.lit(None).cast("string").alias("sample"), pairs.alias("permitted"),
    )
    merged = g.merge_sets(lines, ["run"], "permitted", "sample", "lane", {"n": c.count(), "quantity": c.total("l_quantity")})
    return merged.select("run", F.array_join("merged_lanes", "+").alias("lanes"), "n", "quantity")


@plan("grouper_merge_sets", """
    WITH rows AS (SELECT l_orderkey AS run, l_linenumber AS lane, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS sample,
        CASE WHEN l_orderkey % 2 = 1 OR l_linenumber <= 2 THEN 1 WHEN l_linenumber <= 4 THEN 3 ELSE 5 END AS target FROM lineitem),
    lanes AS (SELECT run, lane, target, coalesce(string_agg(DISTINCT sample, ',' ORDER BY sample), '') AS ids FROM rows GROUP BY run, lane, target),
    placed AS (SELECT a.*, CASE WHEN b.lane IS NULL THEN a.lane ELSE a.target END AS head, coalesce(b.ids, '') AS head_ids
        FROM lanes a LEFT JOIN lanes b ON a.run = b.run AND b.lane = a.target),
    bad AS (SELECT DISTINCT run FROM placed WHERE lane <> head AND ids <> '' AND ids <> head_ids),
    merged AS (SELECT run, head, string_agg(CAST(lane AS VARCHAR), '+' ORDER BY lane) AS lanes FROM placed
        WHERE run NOT IN (SELECT run FROM bad) GROUP BY run, head)
    SELECT r.run AS l_orderkey, m.lanes, count(*) AS n, sum(r.q) AS quantity
    FROM rows r JOIN placed p ON r.run = p.run AND r.lane = p.lane JOIN merged m ON m.run = p.run AND m.head = p.head
    WHERE p.lane = p.head OR r.sample IS NULL GROUP BY r.run, m.head, m.lanes
""")
def grouper_merge_sets(t: Tables):
    # orders as flow cells, lines as lanes; even orders may merge 1-2, 3-4 and 5-7, odd ones 1-7
    pairs = F.array(*[F.array(*[F.lit(i).cast("bigint") for i in lanes]) for lanes in ((1, 2), (3, 4), (5, 6, 7))])
    whole = F.array(F.array(*[F.lit(i).cast("bigint") for i in range(1, 8)]))
    lines = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("lane"), "l_quantity",
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("sample"),
        F.when(F.col("l_orderkey") % 2 == 0, pairs).otherwise(whole).alias("permitted"),
    )
    merged = g.merge_sets(lines, ["l_orderkey"], "permitted", "sample", "lane", {
        "n": c.count(), "quantity": c.total("l_quantity"),
    })
    return merged.select("l_orderkey", F.array_join("merged_lanes", "+").alias("lanes"), "n", "quantity")


BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def libraries(t: Tables):
    """Parts as sequenced libraries: short codes on single-index runs, pairs of codes on dual ones; some odd masks and codes."""
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    dual = F.col("p_partkey") % 3 == 0
    code = F.when(F.col("p_size") == 33, F.lit("ANNA")).when(dual, F.concat_ws("-", F.substring(bases, 1, 10), F.substring(bases, 11, 6))).otherwise(F.substring(bases, 1, 10))
    mask = F.when(F.col("p_size") == 17, F.lit("y50")).when(dual, F.lit("y*,i8,i4n*,y*")).otherwise(F.lit("y*n1,i6n*"))
    run = F.when(dual, F.col("p_partkey") % 1000).otherwise(F.when(F.col("p_partkey") % 50 != 1, F.col("p_partkey") % 1000))
    return t.part.select(run.alias("run"), mask.alias("mask"), F.array(code).alias("codes"), "p_size", "p_partkey")


@plan("grouper_barcodes", f"""
    WITH rows AS (SELECT CASE WHEN p_partkey % 3 = 0 OR p_partkey % 50 <> 1 THEN p_partkey % 1000 END AS run, p_partkey, p_size, p_partkey % 3 = 0 AS dual,
            {BASES.format("CAST(p_partkey AS VARCHAR)")} AS bases FROM part),
    codes AS (SELECT run, p_partkey, p_size, dual, CASE WHEN dual THEN left(bases, 8) ELSE left(bases, 6) END AS one, CASE WHEN dual THEN substr(bases, 11, 4) ELSE '' END AS two,
            CASE WHEN p_size = 17 THEN 'y50' WHEN dual THEN 'd' ELSE 's' END AS mask FROM rows),
    bad AS (SELECT coalesce(run, -1) AS r FROM codes GROUP BY 1 HAVING count(DISTINCT mask) > 1 OR min(mask) = 'y50' OR max(CASE WHEN p_size = 33 THEN 1 ELSE 0 END) = 1),
    clash AS (SELECT DISTINCT coalesce(a.run, -1) AS r FROM codes a JOIN codes b ON coalesce(a.run, -1) = coalesce(b.run, -1) AND a.p_partkey < b.p_partkey
        WHERE length(a.one) = length(b.one) AND hamming(a.one || a.two, b.one || b.two) < 4)
    SELECT run, CASE WHEN dual THEN '8x4' ELSE '6' END AS code_length, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size,
        string_agg(CASE WHEN dual THEN one || '-' || two ELSE one END, ' ' ORDER BY CASE WHEN dual THEN one || '-' || two ELSE one END) AS codes,
        min(CASE WHEN dual THEN 'y*,i8n*,i4n*,y*' ELSE 'y*n1,i6n*' END) AS mask
    FROM codes WHERE coalesce(run, -1) NOT IN (SELECT r FROM bad UNION SELECT r FROM clash) GROUP BY run, 2
""")
def grouper_barcodes(t: Tables):
    # a group has one kind of run, so codes of unlike lengths never meet here
    return g.barcodes(libraries(t), ["run"], "mask", "codes", 4, {
        "n": c.count(), "size": c.total("p_size"), "codes": c.lexical_concat(F.array_join("trimmed_codes", "+"), " "), "mask": c.univalued("new_mask"),
    })


@plan("greedy_bins", """
    WITH RECURSIVE entries AS (SELECT l_orderkey AS o, CAST(l_linenumber AS VARCHAR) AS k, min(CAST(trunc(l_quantity) AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2),
    cheap AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY v DESC, k) AS i FROM entries WHERE v < 50),
    steps AS (
        SELECT o, 0 AS i, [] :: STRUCT(room BIGINT, names VARCHAR[])[] AS bins FROM (SELECT DISTINCT o FROM entries)
        UNION ALL
        SELECT s.o, s.i + 1, CASE WHEN f.at = 0 THEN list_append(s.bins, {'room': 50 - c.v, 'names': [c.k]})
            ELSE list_transform(s.bins, lambda b, j: CASE WHEN j = f.at THEN {'room': b.room - c.v, 'names': list_append(b.names, c.k)} ELSE b END) END
        FROM steps s JOIN cheap c ON c.o = s.o AND c.i = s.i + 1,
            LATERAL (SELECT coalesce(list_position(list_transform(s.bins, lambda b: b.room > 0 AND b.room >= c.v), true), 0) AS at) f
    ),
    filled AS (SELECT o, arg_max(bins, i) AS bins FROM steps GROUP BY o),
    dear AS (SELECT o, list([k]) AS bins FROM entries WHERE v >= 50 GROUP BY o),
    every AS (SELECT f.o, list_sort(list_concat(coalesce(d.bins, []), list_transform(f.bins, lambda b: list_sort(b.names)))) AS bins FROM filled f LEFT JOIN dear d USING (o))
    SELECT o AS l_orderkey, array_to_string(list_transform(bins, lambda b: array_to_string(b, '+')), ' | ') AS bins, CAST(len(bins) AS INTEGER) AS n FROM every
""")
def greedy_bins(t: Tables):
    costs = c.dictionary(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint"))
    orders = grp.group_by(t.lineitem, ["l_orderkey"], {"costs": costs})
    bins = F.transform(g.greedy_bins("costs", 50), lambda b: F.array_join(b, "+"))
    return orders.select("l_orderkey", F.array_join(bins, " | ").alias("bins"), F.size(bins).alias("n"))


def tally(*keys: str):
    """A user grouper: count and total per group, batch by batch.

    The function is made here so that it travels to the workers by itself.
    """

    def split(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, 0.0
        for batch in batches:
            rows += batch.num_rows
            total += pc.sum(batch.column("l_quantity")).as_py() or 0.0
        yield pa.RecordBatch.from_pydict({**{k: [v.as_py()] for k, v in zip(keys, key)}, "n": [rows], "quantity": [total]})

    return split


@plan("grouped_map", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey")
def grouped_map(t: Tables):
    lines = t.lineitem.select("l_suppkey", "l_quantity")
    return g.grouped_map(lines, ["l_suppkey"], tally("l_suppkey"), "l_suppkey bigint, n bigint, quantity double")


@plan("span_length_by_name", """
    SELECT p_brand AS name, CAST(sum(abs(p_size - p_partkey)) AS BIGINT) AS length FROM part GROUP BY p_brand
""")
def span_length_by_name(t: Tables):
    spans = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("start"), F.col("p_size").cast("bigint").alias("end"))
    return g.span_length_by_name(spans, "name", "start", "end")
