"""Standard functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import dates, numbers, paths, signatures, strings
from sluice.functions import documents as d
from sluice.plans.registry import columns

EVENT, ORDER, PART, PAGE, DOC, CUSTOMER, LINE = (
    ["event_id"], ["o_orderkey"], ["p_partkey"], ["page_id"], ["doc_id"], ["c_custkey"], ["l_orderkey", "l_linenumber"],
)
ZONE = "America/Toronto"
LOCAL = f"(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')"

columns("fn_date_to_seconds", "events", EVENT, lambda: {"v": dates.to_seconds("ts")}, {"v": "epoch_us(ts) // 1000000"})
columns("fn_date_to_millis", "events", EVENT, lambda: {"v": dates.to_millis("ts")}, {"v": "epoch_us(ts) // 1000"})

_PARTS = {
    "year": (dates.year, "year({})"),
    "day_of_year": (dates.day_of_year, "dayofyear({})"),
    "day_of_month": (dates.day_of_month, "day({})"),
    "hour_of_day": (dates.hour_of_day, "hour({})"),
    "minute_of_hour": (dates.minute_of_hour, "minute({})"),
    "second_of_minute": (dates.second_of_minute, "second({})"),
    "month": (dates.month, "upper(monthname({}))"),
    "day_of_week": (dates.day_of_week, "upper(dayname({}))"),
}
for _name, (_fn, _sql) in _PARTS.items():
    columns(f"fn_date_utc_{_name}", "events", EVENT, lambda fn=_fn: {"v": fn("ts")}, {"v": _sql.format("ts")})
    columns(f"fn_date_local_{_name}", "events", EVENT, lambda fn=_fn: {"v": fn("ts", ZONE)}, {"v": _sql.format(LOCAL)})

columns("fn_date_from_seconds", "orders", ORDER, lambda: {"v": dates.from_seconds(F.col("o_custkey") * 86399)}, {
    "v": "TIMESTAMP '1970-01-01' + to_seconds(o_custkey * 86399)",
})
columns("fn_date_from_millis", "orders", ORDER, lambda: {"v": dates.from_millis(F.col("o_custkey") * 86399123)}, {
    "v": "TIMESTAMP '1970-01-01' + to_milliseconds(o_custkey * 86399123)",
})


def _calendar():
    """Year, month and day numbers that are sometimes no date."""
    return F.lit(1990) + F.col("p_size"), F.col("p_partkey") % 13, F.col("p_size") % 33


YMD = "try_cast(printf('%04d-%02d-%02d', 1990 + p_size, p_partkey % 13, p_size % 33) AS TIMESTAMP)"
columns("fn_date_utc_date", "part", PART, lambda: {"v": F.coalesce(F.unix_seconds(dates.date(*_calendar())), F.lit(-1))}, {
    "v": f"coalesce(epoch_us({YMD}) // 1000000, -1)",
})
columns("fn_date_local_date", "part", PART, lambda: {"v": F.coalesce(F.unix_seconds(dates.date(*_calendar(), zone="Asia/Tokyo")), F.lit(-1))}, {
    "v": f"coalesce(epoch_us({YMD}) // 1000000 - 32400, -1)",
})


def _clock():
    return F.col("p_size") % 25, F.col("p_partkey") % 60, F.col("p_size") % 60, F.lit(123456789)


STAMP = (
    "try_cast(CASE WHEN p_size % 25 < 24 THEN printf('%04d-%02d-%02d %02d:%02d:%02d.123456', 1990 + p_size, p_partkey % 13,"
    " p_size % 33, p_size % 25, p_partkey % 60, p_size % 60) END AS TIMESTAMP)"
)
columns("fn_date_utc_date_time", "part", PART, lambda: {
    "v": F.coalesce(F.unix_micros(dates.date_time(*_calendar(), *_clock())), F.lit(-1)),
}, {"v": f"coalesce(epoch_us({STAMP}), -1)"})
columns("fn_date_local_date_time", "part", PART, lambda: {
    "v": F.coalesce(F.unix_micros(dates.date_time(*_calendar(), *_clock(), zone="Asia/Tokyo")), F.lit(-1)),
}, {"v": f"coalesce(epoch_us({STAMP}) - 32400000000, -1)"})
columns("fn_date_start_of_day", "events", EVENT, lambda: {"v": dates.start_of_day("ts")}, {"v": "CAST(date_trunc('day', ts) AS TIMESTAMP)"})
columns("d_epoch", "events", EVENT, lambda: {"v": dates.to_seconds("ts") - dates.to_seconds(dates.epoch())}, {
    "v": "epoch_us(ts) // 1000000",
})
columns("d_now", "events", EVENT, lambda: {
    "past": F.col("ts") < dates.now(), "later": F.col("ts") + F.make_interval(years=(F.col("event_id") % 9).cast("int")) < dates.now(),
}, {
    "past": "ts < now()::TIMESTAMP", "later": "ts + to_years(CAST(event_id % 9 AS INTEGER)) < now()::TIMESTAMP",
})

# ------------------------------------------------------------------ numbers


def _infinite():
    return F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity"))


def _nan():
    return F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))


columns("fn_float_is_infinite", "lineitem", LINE, lambda: {"v": numbers.is_infinite(_infinite())}, {"v": "l_discount = 0"})
columns("fn_float_is_nan", "lineitem", LINE, lambda: {"v": numbers.is_nan(_nan())}, {"v": "l_discount = 0"})
columns("fn_float_max", "lineitem", LINE, lambda: {
    "v": numbers.larger("l_discount", "l_tax"), "nan": F.isnan(numbers.larger(_nan(), F.col("l_tax"))),
}, {"v": "greatest(l_discount, l_tax)", "nan": "l_discount = 0"})
columns("fn_float_min", "lineitem", LINE, lambda: {
    "v": numbers.smaller_float("l_discount", "l_tax"), "nan": F.isnan(numbers.smaller_float(_nan(), F.col("l_tax"))),
}, {"v": "least(l_discount, l_tax)", "nan": "l_discount = 0"})
columns("fn_float_clamp", "lineitem", LINE, lambda: {"v": numbers.clamp(F.lit(10.0), "l_quantity", F.lit(20.0))}, {
    "v": "greatest(10.0::DOUBLE, least(l_quantity, 20.0::DOUBLE))",
})
columns("fn_integer_max", "lineitem", LINE, lambda: {"v": numbers.larger("l_partkey", "l_suppkey")}, {"v": "greatest(l_partkey, l_suppkey)"})
columns("fn_integer_min", "lineitem", LINE, lambda: {"v": numbers.smaller("l_partkey", "l_suppkey")}, {"v": "least(l_partkey, l_suppkey)"})
columns("fn_integer_clamp", "lineitem", LINE, lambda: {"v": numbers.clamp(F.lit(100), "l_partkey", F.lit(1000))}, {
    "v": "greatest(100, least(l_partkey, 1000))",
})
columns("fn_float_to_integer", "lineitem", LINE, lambda: {"v": numbers.to_integer(-F.col("l_extendedprice"))}, {
    "v": "CAST(trunc(-l_extendedprice) AS BIGINT)",
})
columns("fn_integer_to_float", "lineitem", LINE, lambda: {"v": numbers.to_float("l_partkey")}, {"v": "CAST(l_partkey AS DOUBLE)"})
columns("fn_integer_parse", "part", PART, lambda: {
    "v": F.coalesce(numbers.parse_integer(F.regexp_replace("p_brand", "Brand#", "")), F.lit(-1)),
    "bad": numbers.parse_integer("p_brand").isNull(),
}, {"v": "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)", "bad": "true"})
columns("fn_float_parse", "customer", CUSTOMER, lambda: {
    "v": numbers.parse_float(F.concat(F.col("c_acctbal").cast("string"), F.lit(" "))), "bad": numbers.parse_float("c_name").isNull(),
}, {"v": "c_acctbal", "bad": "true"})


def _flag():
    return F.when(F.col("p_size") > 30, "TRUE").when(F.col("p_size") > 10, "False").otherwise(F.col("p_type"))


columns("fn_boolean_parse", "part", PART, lambda: {"v": F.coalesce(numbers.parse_boolean(_flag()).cast("string"), F.lit("none"))}, {
    "v": "CASE WHEN p_size > 30 THEN 'true' WHEN p_size > 10 THEN 'false' ELSE 'none' END",
})


def _version():
    return F.struct(F.col("l_linenumber").cast("bigint").alias("_0"), F.col("l_suppkey").alias("_1"), F.col("l_partkey").alias("_2"))


_VERSION_SQL = "(l_linenumber, l_suppkey, l_partkey)"
columns("fn_version_at_least", "lineitem", LINE, lambda: {"v": numbers.version_at_least(_version(), 4, 50, 100)}, {
    "v": "l_linenumber > 4 OR (l_linenumber = 4 AND (l_suppkey > 50 OR (l_suppkey = 50 AND l_partkey >= 100)))",
})
columns("fn_version_less_than", "lineitem", LINE, lambda: {"v": numbers.version_less_than(_version(), 4, 50, 100)}, {
    "v": "NOT (l_linenumber > 4 OR (l_linenumber = 4 AND (l_suppkey > 50 OR (l_suppkey = 50 AND l_partkey >= 100))))",
})

# ------------------------------------------------------------------ strings


def _padded():
    return F.concat(F.lit("\t  "), F.col("p_name"), F.lit(" \n"))


columns("fn_string_trim", "part", PART, lambda: {"v": strings.trim(_padded())}, {"v": "p_name"})
columns("fn_string_truncate", "part", PART, lambda: {
    "s": strings.truncate("p_name", 6, "START"), "se": strings.truncate("p_name", 6, "START_ELLIPSIS", ".."),
    "m": strings.truncate("p_name", 6, "MIDDLE"), "me": strings.truncate("p_name", 6, "MIDDLE_ELLIPSIS", ".."),
    "e": strings.truncate("p_name", 6, "END"), "ee": strings.truncate("p_name", 6, "END_ELLIPSIS", ".."),
    "filled": strings.truncate("p_name", 2, "END_ELLIPSIS", "..."),
}, {
    n: f"CASE WHEN length(p_name) < {limit} THEN p_name ELSE {cut} END"
    for n, limit, cut in (
        ("s", 6, "left(p_name, 6)"), ("se", 6, "left(p_name, 4) || '..'"), ("m", 6, "left(p_name, 3) || right(p_name, 3)"),
        ("me", 6, "left(p_name, 2) || '..' || right(p_name, 2)"), ("e", 6, "right(p_name, 6)"),
        ("ee", 6, "'..' || right(p_name, 4)"), ("filled", 2, "'...'"),
    )
})
columns("fn_string_lower", "documents", DOC, lambda: {"v": F.md5(strings.lower("text").cast("binary"))}, {"v": "md5(lower(text))"})
columns("fn_string_upper", "part", PART, lambda: {"v": strings.upper("p_name")}, {"v": "upper(p_name)"})
columns("fn_string_eq", "part", PART, lambda: {"v": strings.equal_ignoring_case(F.lower("p_type"), F.lit("PROMO"))}, {"v": "p_type = 'PROMO'"})
columns("fn_string_length", "documents", DOC, lambda: {"v": strings.length("text")}, {"v": "length(text)"})
_FOLD = (
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),"
    " lambda h, c: (h * 31 + c) % 4294967296)"
)
columns("fn_string_hash", "conversations", ["conv_id", "turn"], lambda: {"v": strings.hash_code("text")}, {
    "v": f"{_FOLD} - CASE WHEN {_FOLD} >= 2147483648 THEN 4294967296 ELSE 0 END",
})
columns("fn_string_replace", "documents", DOC, lambda: {"v": F.md5(strings.replace("text", "e.", "E!").cast("binary"))}, {
    "v": "md5(replace(text, 'e.', 'E!'))",
})
columns("fn_url_encode", "pages", PAGE, lambda: {"v": strings.url_encode("url")}, {"v": "url_encode(url)"})
columns("fn_url_decode", "pages", PAGE, lambda: {"v": F.coalesce(strings.url_decode(strings.url_encode("url")), F.lit("-"))}, {"v": "url"})


def _dotted():
    return F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"),
                       F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")),
                       F.when(F.col("l_returnflag") == "A", F.lit("x")))


def _parsed():
    v = strings.parse_version(_dotted())
    return {"found": v.isNotNull(), "major": F.coalesce(v["_0"], F.lit(-1)), "minor": F.coalesce(v["_1"], F.lit(-1)), "patch": F.coalesce(v["_2"], F.lit(-1))}


columns("t_parse_version", "lineitem", LINE, _parsed, {
    "found": "l_returnflag <> 'A'", "major": "CASE WHEN l_returnflag <> 'A' THEN l_linenumber ELSE -1 END",
    "minor": "CASE WHEN l_returnflag <> 'A' THEN l_suppkey ELSE -1 END",
    "patch": "CASE l_returnflag WHEN 'R' THEN l_partkey WHEN 'N' THEN 0 ELSE -1 END",
})
columns("t_parse_lane", "lineitem", LINE, lambda: {
    "v": strings.parse_lane(
        F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string"))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("lane_"), "l_linenumber")).otherwise(F.lit("lane"))
    ),
}, {"v": "CASE WHEN l_returnflag IN ('R', 'A') THEN l_linenumber ELSE 0 END"})
columns("t_first_match", "part", PART, lambda: {
    "v": strings.first_match(F.concat_ws(":", "p_type", "p_brand", "p_name"), "(Brand#1.|PROMO)"),
}, {
    "v": "CASE WHEN p_type = 'PROMO' THEN p_type WHEN regexp_full_match(p_brand, 'Brand#1.') THEN p_brand ELSE '' END",
})

# -------------------------------------------------------------------- paths

SITE = "regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '')"


def _path():
    """The page address as an absolute path."""
    return F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")


def _clean():
    return paths.to_path(_path())


CLEAN = f"regexp_replace({SITE}, '(.)/$', '\\1')"

columns("fn_string_to_path", "pages", PAGE, lambda: {"v": paths.to_path(F.regexp_replace(_path(), "/", "//"))}, {"v": CLEAN})
columns("fn_path_file", "pages", PAGE, lambda: {"v": paths.file(_clean())}, {"v": f"regexp_extract({CLEAN}, '[^/]+$')"})
columns("fn_path_dir", "pages", PAGE, lambda: {"v": paths.directory(_clean())}, {"v": f"regexp_replace({CLEAN}, '/[^/]+$', '')"})
columns("fn_path_normalize", "pages", PAGE, lambda: {
    "v": paths.normalize(F.concat(_clean(), F.lit("/./a/../b/.."))), "root": paths.normalize(F.concat(F.lit("/../.."), _clean())),
    "relative": paths.normalize(F.concat(F.lit("x/../../y"), _clean())),
}, {"v": CLEAN, "root": CLEAN, "relative": f"'../y' || {CLEAN}"})
columns("fn_path_relativize", "pages", PAGE, lambda: {
    "down": paths.relativize(F.lit("/"), _clean()), "up": paths.relativize(_clean(), paths.directory(_clean())),
    "side": paths.relativize(F.concat(paths.directory(_clean()), F.lit("/other/x")), _clean()),
}, {
    "down": f"substring({CLEAN}, 2)", "up": "'..'", "side": f"'../../' || regexp_extract({CLEAN}, '[^/]+$')",
})
columns("fn_path_replace_home", "pages", PAGE, lambda: {
    "v": paths.replace_home(F.concat(F.lit("~"), _clean()), F.lit("/home/me")),
    "w": paths.replace_home(F.concat(F.lit("$HOME"), _clean()), F.lit("/home/me")), "x": paths.replace_home(_clean(), F.lit("/home/me")),
}, {"v": f"'/home/me' || {CLEAN}", "w": f"'/home/me' || {CLEAN}", "x": CLEAN})
columns("fn_path_change_prefix", "pages", PAGE, lambda: {
    "v": paths.change_prefix(F.concat(F.lit("/data/old"), _clean()), {"/data": "/mnt/all", "/data/old": "/mnt/new", "/dat": "/no"}),
}, {"v": f"'/mnt/new' || {CLEAN}"})
columns("fn_path_starts_with", "pages", PAGE, lambda: {
    "v": paths.starts_with(F.concat(F.lit("/data/old"), _clean()), F.lit("/data/old")),
    "w": paths.starts_with(F.concat(F.lit("/data/older"), _clean()), F.lit("/data/old")),
    "x": paths.starts_with(_clean(), F.lit("data")),
}, {"v": "true", "w": "false", "x": "false"})
columns("fn_path_ends_with", "pages", PAGE, lambda: {
    "v": paths.ends_with(_clean(), paths.file(_clean())), "w": paths.ends_with(_clean(), F.lit("853")), "x": paths.ends_with(_clean(), F.lit("/853")),
}, {"v": "true", "w": f"regexp_extract({CLEAN}, '[^/]+$') = '853'", "x": f"{CLEAN} = '/853'"})

# --------------------------------------------------------------------- json


def _fields():
    return F.array(
        F.struct(F.lit("size").alias("_0"), F.col("p_size").cast("string").alias("_1")),
        F.struct(F.col("p_brand").alias("_0"), F.concat(F.lit('"'), F.col("p_type"), F.lit('"')).alias("_1")),
    )


columns("fn_json_object", "part", PART, lambda: {"v": d.obj(_fields())}, {
    "v": """'{"size":' || p_size || ',"' || p_brand || '":"' || p_type || '"}'""",
})
columns("fn_json_array_from_dict", "part", PART, lambda: {
    "v": d.array_from_dict(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("key"), F.col("p_partkey").cast("string"))),
}, {"v": """'[["key",' || p_partkey || '],["size",' || p_size || ']]'"""})
columns("fn_json_encode", "events", EVENT, lambda: {"v": d.encode(F.try_parse_json("props"))}, {
    "v": """'{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'""",
})
columns("fn_json_decode", "events", EVENT, lambda: {
    "k": F.get_json_object(d.decode("props"), "$.k").cast("bigint"), "pair": F.get_json_object(d.decode(F.concat(F.lit("["), "props", F.lit(",3]"))), "$[1]").cast("bigint"),
    "bad": d.decode(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("["), "props")).otherwise(F.col("props"))).isNull(),
}, {
    "k": "CAST(json_extract(props, '$.k') AS BIGINT)", "pair": "3::BIGINT", "bad": "user_id % 2 = 0",
})
columns("fn_json_parse", "events", EVENT, lambda: {"v": d.parse("props"), "bad": d.parse("event_type").isNull()}, {
    "v": """'{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}'""", "bad": "true",
})

# --------------------------------------------------------------- signatures

_SIGNABLE = signatures.signable_read(["p_brand", "p_size", "p_type"], ["p_size", "p_brand", "p_partkey"])

columns("signature_count", "part", PART, lambda: {"v": signatures.count(_SIGNABLE)}, {"v": "2"})
columns("signature_names", "part", PART, lambda: {"v": F.array_join(signatures.names(_SIGNABLE), ",")}, {"v": "'p_brand,p_size'"})
columns("signature_json", "part", PART, lambda: {"v": signatures.as_json(_SIGNABLE)}, {
    "v": """'{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'""",
})
columns("signature_sha1", "part", PART, lambda: {"v": signatures.sha1(_SIGNABLE), "none": signatures.sha1([])}, {
    "v": """upper(sha1('p_brand:["' || p_brand || '"]p_size:[' || p_size || ']'))""",
    "none": "'DA39A3EE5E6B4B0D3255BFEF95601890AFD80709'",
})


def _external():
    return F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("provider"), F.lit(False).alias("stale"),
        F.create_map(F.lit("v"), F.col("o_orderpriority")).alias("versions"),
    )


def _key():
    key = signatures.key_id(_external())
    return {"id": key["id"], "provider": key["provider"]}


columns("t_key_id", "orders", ORDER, _key, {"id": "CAST(o_orderkey AS VARCHAR)", "provider": "o_orderstatus"})
columns("t_key_sign", "orders", ORDER, lambda: {
    "signed": F.try_element_at(signatures.key_sign(_external(), F.sha1(F.col("o_orderpriority").cast("binary")))["versions"], F.lit("sha1")),
    "n": F.size(F.map_keys(signatures.key_sign(_external(), F.lit("x"))["versions"])),
}, {"signed": "sha1(o_orderpriority)", "n": "2"})
