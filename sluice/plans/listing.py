"""List pipelines, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import lists as l
from sluice.plans.registry import Tables, columns, plan

PART, EVENT, CONV, VEC = ["p_partkey"], ["event_id"], ["conv_id", "turn"], ["vec_id"]

W = "string_split(text, ' ')"
JOIN = "coalesce(array_to_string({}, ' '), '')"


def words():
    return F.split("text", " ")


def joined(a):
    return F.array_join(a, " ")


def lengths():
    return F.transform(words(), lambda w: F.length(w).cast("bigint"))


LEN = f"list_transform({W}, lambda w: length(w))"

columns("l_source_in", "events", EVENT, lambda: {
    "optional": F.size(l.from_optional(F.when(F.col("value") > 100, F.col("event_type")))),
    "entries": F.array_join(F.transform(
        l.from_map(F.create_map("event_type", "user_id")), lambda e: F.concat(e["_0"], F.lit("="), e["_1"].cast("string"))), ","),
    "json": F.array_join(l.from_json("props"), ","),
}, {
    "optional": "CASE WHEN value > 100 THEN 1 ELSE 0 END", "entries": "event_type || '=' || user_id",
    "json": "CAST(json_extract(props, '$.k') AS VARCHAR)",
})
columns("l_source_fields", "events", EVENT, lambda: {
    "v": F.array_join(F.transform(l.json_fields("props"), lambda f: F.concat(f["name"], F.lit(":"), f["value"])), ","),
}, {"v": "'k:' || CAST(json_extract(props, '$.k') AS VARCHAR)"})
columns("l_source_range", "part", PART, lambda: {
    "v": F.array_join(l.span(F.lit(5), F.col("p_size")).cast("array<string>"), ","),
}, {"v": "coalesce(array_to_string(range(5, p_size), ','), '')"})
columns("l_source_split", "conversations", CONV, lambda: {
    "v": F.size(l.split("text", r"[.\n]")).cast("bigint"), "w": F.array_join(l.split("text", r"[.\n]"), "|"),
}, {
    "v": r"len(string_split(regexp_replace(replace(text, chr(10), '.'), '\.+$', ''), '.'))",
    "w": r"replace(regexp_replace(replace(text, chr(10), '.'), '\.+$', ''), '.', '|')",
})


def _zipped():
    a = F.array(F.struct(F.lit(1).alias("_0"), F.col("p_brand").alias("_1")), F.struct(F.col("p_size").alias("_0"), F.col("p_type").alias("_1")))
    b = F.array(F.struct(F.lit(1).alias("_0"), F.col("p_name").alias("_1")))
    rows = l.zipped(a, b, 2, 2)
    text = F.transform(rows, lambda r: F.concat_ws("/", r["_0"].cast("string"), F.coalesce(r["_1"], F.lit("?")), F.coalesce(r["_2"], F.lit("?"))))
    return {"v": F.array_join(text, ",")}


columns("l_source_zip", "part", PART, _zipped, {
    "v": "'1/' || p_brand || '/' || p_name || CASE WHEN p_size = 1 THEN '' ELSE ',' || p_size || '/' || p_type || '/?' END",
})

columns("l_map", "conversations", CONV, lambda: {"v": joined(l.mapped(words(), lambda w: F.concat(F.length(w).cast("string"), w)))}, {
    "v": JOIN.format(f"list_transform({W}, lambda w: length(w) || w)"),
})
columns("l_where", "conversations", CONV, lambda: {"v": joined(l.where(words(), lambda w: F.length(w) > 6))}, {
    "v": JOIN.format(f"list_filter({W}, lambda w: length(w) > 6)"),
})
columns("l_flatten", "conversations", CONV, lambda: {
    "v": joined(l.flat_map(F.split("text", r"\n"), lambda line: F.split(line, " "))),
}, {"v": JOIN.format("flatten(list_transform(string_split(text, chr(10)), lambda s: string_split(s, ' ')))")})
columns("l_distinct", "conversations", CONV, lambda: {"v": F.size(l.distinct(words())).cast("bigint")}, {"v": f"len(list_distinct({W}))"})
columns("l_sort", "conversations", CONV, lambda: {
    "v": joined(l.sort(words(), lambda w: F.length(w)).cast("array<string>")),
    "w": F.array_join(l.sort(lengths(), lambda n: -n).cast("array<string>"), ","),
}, {
    "v": f"array_to_string(list_transform(list_sort(list_transform({W}, lambda w, i: {{'k': length(w), 'i': i, 'w': w}})), lambda s: s.w), ' ')",
    "w": f"array_to_string(list_reverse_sort({LEN}), ',')",
})
columns("l_reverse", "conversations", CONV, lambda: {"v": joined(l.reverse(words()))}, {"v": JOIN.format(f"list_reverse({W})")})
columns("l_limit", "conversations", CONV, lambda: {"v": joined(l.limit(words(), 3))}, {"v": JOIN.format(f"({W})[1:3]")})
columns("l_skip", "conversations", CONV, lambda: {"v": joined(l.skip(words(), 3))}, {"v": JOIN.format(f"({W})[4:]")})


def _sampled():
    ordered = F.sort_array(words())
    return {
        "first": joined(l.subsample(ordered, l.Fixed(4))),
        "short": joined(l.subsample(ordered, l.Fixed(8, lambda w: F.length(w) < 4))),
        "even": joined(l.subsample(ordered, l.Squish(5))),
        "both": joined(l.subsample(ordered, l.Fixed(1), l.Squish(3))),
    }


S = f"list_sort({W})"


def _squish(rest: str, n: int) -> str:
    return (
        f"CASE WHEN len({rest}) <= {n} THEN {rest} ELSE list_filter({rest}, lambda w, i:"
        f" (i - 1) % (len({rest}) // {n}) = 0 AND (i - 1) // (len({rest}) // {n}) < {n}) END"
    )


columns("l_subsample", "conversations", CONV, _sampled, {
    "first": JOIN.format(f"({S})[1:4]"),
    "short": JOIN.format(
        f"list_filter(({S})[1:8], lambda w, i: len(list_filter(({S})[1:8], lambda u, j: j <= i AND length(u) >= 4)) = 0)"
    ),
    "even": JOIN.format(_squish(f"({S})[1:]", 5)),
    "both": JOIN.format(f"list_concat(({S})[1:1], {_squish(f'({S})[2:]', 3)})"),
})

columns("l_any", "conversations", CONV, lambda: {"v": l.any_match(words(), lambda w: F.length(w) > 12)}, {
    "v": f"len(list_filter({W}, lambda w: length(w) > 12)) > 0",
})
columns("l_all", "conversations", CONV, lambda: {"v": l.all_match(words(), lambda w: F.length(w) < 12)}, {
    "v": f"len(list_filter({W}, lambda w: length(w) >= 12)) = 0",
})
columns("l_none", "conversations", CONV, lambda: {"v": l.none_match(words(), lambda w: w.contains("the"))}, {
    "v": f"len(list_filter({W}, lambda w: contains(w, 'the'))) = 0",
})
columns("l_count", "embeddings", VEC, lambda: {"v": l.count(l.where("embedding", lambda e: e > 0))}, {
    "v": "len(list_filter(embedding, lambda e: e > 0))",
})
columns("l_first", "conversations", CONV, lambda: {
    "v": F.coalesce(l.first(l.where(words(), lambda w: F.length(w) > 9)), F.lit("-")),
}, {"v": f"coalesce(list_filter({W}, lambda w: length(w) > 9)[1], '-')"})
columns("l_list", "conversations", CONV, lambda: {"v": joined(l.listing(words()))}, {"v": JOIN.format(f"list_sort(list_distinct({W}))")})
columns("l_dict", "part", PART, lambda: {
    "v": F.try_element_at(l.dictionary(F.split("p_name", " "), lambda w: F.upper(w), lambda w: F.length(w)), F.lit("RED")).isNotNull(),
    "n": F.size(F.map_keys(l.dictionary(F.split("p_name", " "), lambda w: w, lambda w: F.length(w)))).cast("bigint"),
}, {"v": "list_contains(string_split(p_name, ' '), 'red')", "n": "len(list_distinct(string_split(p_name, ' ')))"})
columns("l_max", "conversations", CONV, lambda: {"v": l.maximum(words(), lambda w: F.length(w))}, {
    "v": f"list_reverse_sort(list_transform({W}, lambda w: {{'k': length(w), 'x': w}}))[1].x",
})
columns("l_min", "conversations", CONV, lambda: {"v": l.minimum(words(), lambda w: F.length(w))}, {
    "v": f"list_sort(list_transform({W}, lambda w: {{'k': length(w), 'x': w}}))[1].x",
})
columns("l_concat_lexical", "conversations", CONV, lambda: {"v": l.lexical_concat(words(), ", ")}, {"v": f"array_to_string(list_sort({W}), ', ')"})
columns("l_concat_fixed", "conversations", CONV, lambda: {"v": l.fixed_concat(words(), ", ")}, {"v": f"array_to_string({W}, ', ')"})
columns("l_sum", "conversations", CONV, lambda: {"v": l.total(lengths())}, {"v": f"CAST(list_sum({LEN}) AS BIGINT)"})


def _stats():
    s = l.stats(lengths(), "bigint")
    return {n: s[n] for n in ("average", "count", "maximum", "minimum", "sum")}


columns("l_stats", "conversations", CONV, _stats, {
    "average": f"CAST(list_sum({LEN}) AS DOUBLE) / len({LEN})", "count": f"len({LEN})", "maximum": f"list_max({LEN})",
    "minimum": f"list_min({LEN})", "sum": f"CAST(list_sum({LEN}) AS BIGINT)",
})
columns("l_reduce", "conversations", CONV, lambda: {
    "v": l.reduce(lengths(), F.lit(1).cast("bigint"), lambda a, n: (a * 31 + n) % 1000003),
}, {"v": f"list_reduce(list_prepend(1, {LEN}), lambda a, n: (a * 31 + n) % 1000003)"})


def _partition():
    p = l.partition_count(words(), lambda w: F.length(w) > 4)
    return {"matched_count": p["matched_count"], "not_matched_count": p["not_matched_count"]}


columns("l_partition_count", "conversations", CONV, _partition, {
    "matched_count": f"len(list_filter({W}, lambda w: length(w) > 4))",
    "not_matched_count": f"len(list_filter({W}, lambda w: length(w) <= 4))",
})
columns("l_univalued", "part", PART, lambda: {
    "v": F.coalesce(l.univalued(F.transform(F.split("p_name", " "), lambda w: F.length(w))), F.lit(-1)),
}, {
    "v": "CASE WHEN len(list_distinct(list_transform(string_split(p_name, ' '), lambda w: length(w)))) = 1"
    " THEN length(string_split(p_name, ' ')[1]) ELSE -1 END",
})
columns("l_tuple", "part", PART, lambda: {
    "v": F.coalesce(l.as_tuple(F.split("p_name", " "), 2)["_1"], F.lit("-")),
    "none": l.as_tuple(F.split("p_name", " "), 3).isNull(),
}, {
    "v": "CASE WHEN len(string_split(p_name, ' ')) = 2 THEN string_split(p_name, ' ')[2] ELSE '-' END",
    "none": "len(string_split(p_name, ' ')) <> 3",
})


def _several():
    o = l.obj(lengths(), n=l.count, top=lambda a: F.array_max(a), total=l.total)
    return {"n": o["n"], "top": o["top"], "total": o["total"]}


columns("l_object", "conversations", CONV, _several, {"n": f"len({LEN})", "top": f"list_max({LEN})", "total": f"CAST(list_sum({LEN}) AS BIGINT)"})
columns("l_optional", "conversations", CONV, lambda: {
    "v": l.count(l.present(F.transform(words(), lambda w: F.when(F.length(w) > 5, w)))),
}, {"v": f"len(list_filter({W}, lambda w: length(w) > 5))"})
columns("l_table", "part", PART, lambda: {
    "v": l.table(F.split("p_name", " "), {"Word": lambda w: w, "Size": lambda w: F.length(w)}, l.MARKDOWN),
}, {
    "v": "'|Word|Size|' || chr(10) || '|---|---' || chr(10) || array_to_string("
    "list_transform(string_split(p_name, ' '), lambda w: '|' || w || '|' || length(w) || '|'), chr(10))",
})


@plan("l_source_json", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS item FROM events
""")
def l_source_json(t: Tables):
    return t.events.select("event_id", F.explode(l.from_json("props")).alias("item"))


columns("t_table_style", "part", PART, lambda: {
    style: l.table(F.array("p_brand"), {"Brand": lambda b: b}, s)
    for style, s in (("html", l.HTML), ("markdown", l.MARKDOWN), ("wiki", l.WIKI))
}, {
    "html": "'<tr><th>Brand</th></tr>' || chr(10) || '<tr><td>' || p_brand || '</td></tr>'",
    "markdown": "'|Brand|' || chr(10) || '|---' || chr(10) || '|' || p_brand || '|'",
    "wiki": "'||Brand||' || chr(10) || '|' || p_brand || '|'",
})
