"""Operators and control flow, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import documents as d
from sluice.functions import exprs as x
from sluice.functions import paths
from sluice.operators.clauses import Gangs
from sluice.plans.registry import Tables, columns, plan

ORDER, LINE, PART, EVENT, PAGE, DOC = (
    ["o_orderkey"], ["l_orderkey", "l_linenumber"], ["p_partkey"], ["event_id"], ["page_id"], ["doc_id"],
)

columns("x_if", "orders", ORDER, lambda: {
    "size": x.if_else(F.col("o_totalprice") > 200000, F.lit("large"), F.lit("small")),
}, {"size": "CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END"})

columns("x_switch", "orders", ORDER, lambda: {
    "state": x.switch("o_orderstatus", [(F.lit("O"), F.lit("open")), (F.lit("F"), F.lit("done"))], F.lit("partial")),
}, {"state": "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'partial' END"})


def _shape():
    """An algebraic value per part: SMALL{size}, LARGE{size, brand} or PLAIN."""
    none = F.lit(None).cast("string")
    return (
        F.when(F.col("p_size") < 10, x.tagged("SMALL", size=F.col("p_size"), brand=none))
        .when(F.col("p_size") > 40, x.tagged("LARGE", size=F.col("p_size"), brand=F.col("p_brand")))
        .otherwise(x.tagged("PLAIN", size=F.lit(None).cast("int"), brand=none))
    )


columns("x_match", "part", PART, lambda: {
    "label": x.match(_shape(), {
        "SMALL": lambda v: F.concat(F.lit("s"), v["size"].cast("string")),
        "LARGE": lambda v: F.concat(v["brand"], F.lit("/"), v["size"].cast("string")),
    }, F.lit("plain")),
}, {"label": "CASE WHEN p_size < 10 THEN 's' || p_size WHEN p_size > 40 THEN p_brand || '/' || p_size ELSE 'plain' END"})


def _block():
    net = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = F.col("l_linenumber").cast("bigint")
    return net * lines + lines


columns("x_block", "lineitem", LINE, lambda: {"v": _block()}, {
    "v": "CAST(round(l_extendedprice * 100) AS BIGINT) * l_linenumber + l_linenumber",
})


def _ordered():
    o = x.order(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"))
    return {"low": o["_0"], "mid": o["_1"], "high": o["_2"]}


columns("x_order", "lineitem", LINE, _ordered, {
    "low": "list_sort([l_orderkey, l_partkey, l_suppkey])[1]",
    "mid": "list_sort([l_orderkey, l_partkey, l_suppkey])[2]",
    "high": "list_sort([l_orderkey, l_partkey, l_suppkey])[3]",
})


def _tabulated():
    grid = x.tabulate(
        memory=[F.col("p_size").cast("bigint"), F.col("p_size").cast("bigint") * 2], name=[F.col("p_brand"), F.col("p_type")]
    )
    return {
        "second": F.try_element_at(grid["memory"], F.lit("1")), "name": F.try_element_at(grid["name"], F.lit("0")),
        "n": F.size(F.map_keys(grid["memory"])),
    }


columns("x_tabulate", "part", PART, _tabulated, {"second": "CAST(p_size AS BIGINT) * 2", "name": "p_brand", "n": "2"})

K = "json_extract_string(props, '$.k')"


def _key():
    return F.get_json_object("props", "$.k")


def _large():
    return F.when(F.col("value") > 100, F.col("event_type"))


def _odd():
    return F.when(F.col("user_id") % 2 == 1, F.lit("odd"))


columns("x_default", "events", EVENT, lambda: {"v": x.default(_large(), F.lit("none"))}, {
    "v": "CASE WHEN value > 100 THEN event_type ELSE 'none' END",
})
columns("x_optional_merge", "events", EVENT, lambda: {"v": F.coalesce(x.merge_optionals(_large(), _odd()), F.lit(""))}, {
    "v": "coalesce(CASE WHEN value > 100 THEN event_type END, CASE WHEN user_id % 2 = 1 THEN 'odd' END, '')",
})
columns("x_optional_lift", "events", EVENT, lambda: {
    "v": F.coalesce(x.lift([_large(), _odd()], F.concat_ws("-", _large(), _odd())), F.lit("empty")),
}, {"v": "CASE WHEN value > 100 AND user_id % 2 = 1 THEN event_type || '-odd' ELSE 'empty' END"})

columns("x_and", "lineitem", LINE, lambda: {"v": (F.col("l_quantity") > 10) & (F.col("l_returnflag") == "R")}, {
    "v": "l_quantity > 10 AND l_returnflag = 'R'",
})
columns("x_or", "lineitem", LINE, lambda: {"v": (F.col("l_quantity") > 10) | (F.col("l_returnflag") == "R")}, {
    "v": "l_quantity > 10 OR l_returnflag = 'R'",
})
columns("x_not", "lineitem", LINE, lambda: {"v": ~(F.col("l_returnflag") == "R")}, {"v": "NOT l_returnflag = 'R'"})

columns("x_eq", "events", EVENT, lambda: {
    "optional": x.same(_large(), _odd()),
    "lists": x.set_equal(F.array(F.lit("view"), F.col("event_type")), F.array(F.col("event_type"), F.col("event_type"))),
    "dicts": x.dict_equal(F.create_map(F.lit("a"), F.col("user_id")), F.create_map(F.lit("a"), F.lit(7).cast("bigint"))),
}, {
    "optional": "(CASE WHEN value > 100 THEN event_type END) IS NOT DISTINCT FROM (CASE WHEN user_id % 2 = 1 THEN 'odd' END)",
    "lists": "event_type = 'view'", "dicts": "user_id = 7",
})
columns("x_ne", "events", EVENT, lambda: {"v": ~x.same(_large(), F.lit("view"))}, {
    "v": "(CASE WHEN value > 100 THEN event_type END) IS DISTINCT FROM 'view'",
})
columns("x_cmp", "orders", ORDER, lambda: {
    "lt": F.col("o_orderdate") < x.date_literal("1997-01-01"), "ge": F.col("o_totalprice") >= 250000.0,
    "le": F.col("o_orderpriority") <= "3", "gt": F.col("o_custkey") > F.col("o_orderkey"),
}, {
    "lt": "o_orderdate < TIMESTAMP '1997-01-01'", "ge": "o_totalprice >= 250000.0", "le": "o_orderpriority <= '3'",
    "gt": "o_custkey > o_orderkey",
})
columns("x_regex", "customer", ["c_custkey"], lambda: {
    "v": x.matches("c_name", "customer#0*[1-9][0-9]{2}", "i"),
}, {"v": "regexp_full_match(c_name, '(?i)customer#0*[1-9][0-9]{2}')"})
columns("x_not_regex", "part", PART, lambda: {"v": ~x.matches("p_name", "red .*")}, {"v": "NOT regexp_full_match(p_name, 'red .*')"})


def _captured():
    found = x.capture("url", r"(https?)://([a-z.]+)/([a-z]+)/([0-9]+)(/|\.html)?(\?.*|#.*)?", 6)
    return {
        "found": found.isNotNull(), "host": F.coalesce(found["_1"], F.lit("-")), "page": F.coalesce(found["_3"], F.lit("-")),
        "ending": F.coalesce(found["_4"], F.lit("-")),
    }


URL_RE = r"(https?)://([a-z.]+)/([a-z]+)/([0-9]+)(/|\.html)?(\?.*|#.*)?"
columns("x_regex_bind", "pages", PAGE, _captured, {
    "found": f"regexp_full_match(url, '{URL_RE}')",
    "host": f"coalesce(nullif(regexp_extract(url, '^{URL_RE}$', 2), ''), '-')",
    "page": f"coalesce(nullif(regexp_extract(url, '^{URL_RE}$', 4), ''), '-')",
    "ending": f"coalesce(nullif(regexp_extract(url, '^{URL_RE}$', 5), ''), '-')",
})

def _captured_empty():
    found = x.capture("o_orderpriority", r"([0-9])-(U?)(RGENT)?(.*)", 4)
    return {"letter": F.coalesce(found["_1"], F.lit("-")), "urgent": F.coalesce(found["_2"], F.lit("-")), "rest": F.coalesce(found["_3"], F.lit("-"))}


columns("x_regex_bind_empty", "orders", ["o_orderkey"], _captured_empty, {
    "letter": "CASE WHEN o_orderpriority LIKE '%-U%' THEN 'U' ELSE '' END",
    "urgent": "CASE WHEN o_orderpriority LIKE '%-URGENT%' THEN 'RGENT' ELSE '-' END",
    "rest": "CASE WHEN o_orderpriority LIKE '%-URGENT%' THEN substr(o_orderpriority, 9) ELSE substr(o_orderpriority, 3) END",
})

columns("x_add_num", "lineitem", LINE, lambda: {
    "i": F.col("l_orderkey") + F.col("l_linenumber"), "f": F.col("l_quantity") + F.col("l_linenumber"),
}, {"i": "l_orderkey + l_linenumber", "f": "l_quantity + l_linenumber"})
columns("x_sub_num", "lineitem", LINE, lambda: {
    "i": F.col("l_linenumber") - F.col("l_orderkey"), "f": F.col("l_linenumber") - F.col("l_quantity"),
}, {"i": "l_linenumber - l_orderkey", "f": "l_linenumber - l_quantity"})
columns("x_mul", "lineitem", LINE, lambda: {"i": F.col("l_orderkey") * F.col("l_linenumber"), "f": F.col("l_quantity") * 2}, {
    "i": "l_orderkey * l_linenumber", "f": "l_quantity * 2",
})
columns("x_div", "lineitem", LINE, lambda: {
    "i": x.int_div(F.col("l_linenumber") - F.col("l_orderkey"), F.lit(7)), "f": F.col("l_quantity") / F.col("l_linenumber"),
}, {
    "i": "CAST(trunc((l_linenumber - l_orderkey) / 7) AS BIGINT)", "f": "l_quantity / l_linenumber",
})
columns("x_mod", "lineitem", LINE, lambda: {"v": x.int_mod(F.col("l_linenumber") - F.col("l_orderkey"), F.lit(7))}, {
    "v": "(l_linenumber - l_orderkey) % 7",
})

columns("x_date_plus", "events", EVENT, lambda: {"v": x.date_plus("ts", F.col("user_id"))}, {
    "v": "ts + to_seconds(user_id)",
})
columns("x_date_minus", "events", EVENT, lambda: {"v": x.date_minus("ts", 3600)}, {"v": "ts - INTERVAL 3600 SECOND"})
columns("x_date_diff", "events", EVENT, lambda: {"v": x.date_diff(F.lit("2024-01-15").cast("timestamp"), "ts")}, {
    "v": "CAST(floor((epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 1000000.0) AS BIGINT)",
})

columns("x_path_join", "pages", PAGE, lambda: {
    "v": paths.resolve(F.lit("/srv/site"), F.regexp_replace("url", "^https?:/", "")),
    "w": paths.resolve(F.lit("/srv/site"), F.regexp_replace("url", "^https?://", "")),
}, {
    "v": "regexp_replace(url, '^https?:/', '')", "w": "'/srv/site/' || regexp_replace(url, '^https?://', '')",
})
columns("x_concat", "customer", ["c_custkey"], lambda: {"v": F.concat("c_name", F.lit(":"), F.col("c_nationkey").cast("string"))}, {
    "v": "c_name || ':' || c_nationkey",
})
columns("x_interpolate", "customer", ["c_custkey"], lambda: {"v": x.interpolate(F.col("c_name"), " of ", F.col("c_nationkey"), "!")}, {
    "v": "c_name || ' of ' || c_nationkey || '!'",
})
columns("x_pad", "lineitem", LINE, lambda: {"v": x.pad("l_orderkey", 4)}, {
    "v": "CASE WHEN length(CAST(l_orderkey AS VARCHAR)) >= 4 THEN CAST(l_orderkey AS VARCHAR) ELSE lpad(CAST(l_orderkey AS VARCHAR), 4, '0') END",
})
columns("x_gang_string", "part", PART, lambda: {
    "v": Gangs(label=["p_brand", ("p_type", "SMALL"), "p_size"]).text("label"),
}, {"v": "concat_ws('_', p_brand, nullif(p_type, 'SMALL'), p_size)"})
columns("x_repeat", "part", PART, lambda: {"v": F.repeat(F.col("p_type"), (F.col("p_size") % 4).cast("int"))}, {
    "v": "repeat(p_type, p_size % 4)",
})


def _words(name="p_name"):
    return F.split(F.col(name), " ")


W = "string_split(p_name, ' ')"


def _join(a):
    return F.array_join(a, "|")


def _sql_set(inner: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({inner})), '|'), '')"


columns("x_set_union", "part", PART, lambda: {"v": _join(x.set_union(_words(), F.array("p_type", F.lit("red"))))}, {
    "v": _sql_set(f"list_concat({W}, [p_type, 'red'])"),
})
columns("x_set_add", "part", PART, lambda: {"v": _join(x.set_add(_words(), F.col("p_brand")))}, {"v": _sql_set(f"list_append({W}, p_brand)")})
columns("x_set_diff", "part", PART, lambda: {"v": _join(x.set_diff(_words(), F.array(F.lit("red"), F.lit("bolt"))))}, {
    "v": _sql_set(f"list_filter({W}, lambda w: w NOT IN ('red', 'bolt'))"),
})
columns("x_set_remove", "part", PART, lambda: {"v": _join(x.set_remove(_words(), F.lit("widget")))}, {
    "v": _sql_set(f"list_filter({W}, lambda w: w <> 'widget')"),
})
columns("x_in", "part", PART, lambda: {
    "list": x.contains(_words(), F.lit("blue")), "dict": x.contains_key(F.create_map("p_brand", "p_size"), F.lit("Brand#3")),
}, {"list": f"list_contains({W}, 'blue')", "dict": "p_brand = 'Brand#3'"})
columns("x_count", "part", PART, lambda: {"v": F.size(_words()).cast("bigint")}, {"v": f"len({W})"})
columns("x_neg", "part", PART, lambda: {"v": -F.col("p_size")}, {"v": "-p_size"})


def _pair():
    return F.struct(F.col("p_brand").alias("_0"), F.col("p_size").alias("_1"))


def _tuple4():
    both = x.concat_tuples((_pair(), 2), (F.struct(F.col("p_type").alias("_0"), F.col("p_name").alias("_1")), 2))
    return {f"v{i}": both[f"_{i}"] for i in range(4)}


columns("x_tuple_concat", "part", PART, _tuple4, {"v0": "p_brand", "v1": "p_size", "v2": "p_type", "v3": "p_name"})


def _object():
    return F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


def _merged():
    both = x.merge_objects(_object(), ["brand", "size"], F.struct(F.col("p_name").alias("name")), ["name"])
    return {"brand": both["brand"], "name": both["name"], "size": both["size"]}


columns("x_object_merge", "part", PART, _merged, {"brand": "p_brand", "name": "p_name", "size": "p_size"})
columns("x_object", "part", PART, lambda: {"v": F.to_json(_object())}, {
    "v": """'{"brand":"' || p_brand || '","size":' || p_size || ',"kind":"' || p_type || '"}'""",
})
columns("x_object_rest", "part", PART, lambda: {"v": F.to_json(x.without(_object(), "size"))}, {
    "v": """'{"brand":"' || p_brand || '","kind":"' || p_type || '"}'""",
})
columns("x_get", "part", PART, lambda: {
    "plain": _object()["brand"], "lifted": F.coalesce(F.when(F.col("p_size") > 20, _object())["kind"], F.lit("-")),
}, {"plain": "p_brand", "lifted": "CASE WHEN p_size > 20 THEN p_type ELSE '-' END"})
columns("x_swizzle", "part", PART, lambda: {"v": F.to_json(x.swizzle(_object(), "kind", "brand"))}, {
    "v": """'{"kind":"' || p_type || '","brand":"' || p_brand || '"}'""",
})
columns("x_tuple_get", "part", PART, lambda: {"v": _pair()["_1"]}, {"v": "p_size"})
columns("x_dict_get", "part", PART, lambda: {
    "v": F.coalesce(x.dict_get(F.create_map("p_brand", "p_size"), F.lit("Brand#7")), F.lit(-1)),
}, {"v": "CASE WHEN p_brand = 'Brand#7' THEN p_size ELSE -1 END"})


def _spread():
    base = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    built = x.dictionary((F.lit("type"), F.upper("p_name")), (F.lit("brand"), F.col("p_brand")), spread=[base])
    return {"type": x.dict_get(built, F.lit("type")), "size": x.dict_get(built, F.lit("size")), "n": F.size(F.map_keys(built))}


columns("x_dict", "part", PART, _spread, {"type": "upper(p_name)", "size": "CAST(p_size AS VARCHAR)", "n": "3"})
columns("x_algebraic", "part", PART, lambda: {
    "tag": _shape()["tag"], "brand": F.coalesce(_shape()["brand"], F.lit("-")),
}, {
    "tag": "CASE WHEN p_size < 10 THEN 'SMALL' WHEN p_size > 40 THEN 'LARGE' ELSE 'PLAIN' END",
    "brand": "CASE WHEN p_size > 40 THEN p_brand ELSE '-' END",
})


def _pairs():
    there = x.to_pair(_pair())
    back = x.from_pair(there)
    return {"left_value": there["left"], "right_value": there["right"], "x": back["_0"], "y": back["_1"]}


columns("x_pair_convert", "part", PART, _pairs, {"left_value": "p_brand", "right_value": "p_size", "x": "p_brand", "y": "p_size"})
columns("x_date_literal", "orders", ORDER, lambda: {
    "v": F.col("o_orderdate") >= x.date_literal("1998-06-01T00:00:00+02:00"),
}, {"v": "o_orderdate >= TIMESTAMP '1998-05-31 22:00:00'"})
columns("x_epoch_s", "orders", ORDER, lambda: {"v": F.col("o_orderdate") >= x.epoch_seconds(883612800)}, {
    "v": "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
})
columns("x_epoch_ms", "orders", ORDER, lambda: {"v": F.col("o_orderdate") >= x.epoch_millis(883612800000)}, {
    "v": "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
})
columns("x_units", "part", PART, lambda: {
    "bytes": F.col("p_size") * F.lit(x.units(2, "Gi")), "seconds": F.col("p_size") * F.lit(x.units(3, "weeks")),
    "thousands": F.col("p_size") * F.lit(x.units(1, "k")),
}, {"bytes": "p_size * 2147483648", "seconds": "p_size * 1814400", "thousands": "p_size * 1000"})
columns("x_to_json", "part", PART, lambda: {"v": d.encode(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name")))}, {
    "v": """'{"size":' || p_size || ',"name":"' || p_name || '"}'""",
})
columns("x_from_json", "events", EVENT, lambda: {
    "k": F.coalesce(d.unpack("props", "struct<k:bigint>")["k"], F.lit(-1)), "bad": d.unpack("event_type", "bigint").isNull(),
}, {"k": "CAST(json_extract(props, '$.k') AS BIGINT)", "bad": "true"})
columns("x_json_get", "events", EVENT, lambda: {"k": d.get("props", "k"), "missing": d.get("props", "zz")}, {
    "k": "CAST(json_extract(props, '$.k') AS VARCHAR)", "missing": "'null'",
})


@plan("x_tuple_rest", "SELECT p_partkey, p_type AS kind, p_brand AS brand FROM part")
def x_tuple_rest(t: Tables):
    """Destructuring a tuple built from a row."""
    made = t.part.select("p_partkey", F.struct("p_type", "p_brand").alias("pair"))
    return made.select("p_partkey", F.col("pair.p_type").alias("kind"), F.col("pair.p_brand").alias("brand"))
