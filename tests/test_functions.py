"""Column functions on literal values."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import documents as d
from sluice.functions import exprs as x
from sluice.functions import lists as l
from sluice.functions import masks, numbers, paths, signatures, strings


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ints(*items):
    return F.array(*[F.lit(i) for i in items])


SQUISHED = [-4, -2, 0, 2, 4, 6, 8, 10, 12, 14]


@pytest.mark.parametrize(
    "samplers,items,expected",
    [
        ([l.Fixed(6)], range(1, 8), [1, 2, 3, 4, 5, 6]),
        ([l.Fixed(8, lambda v: v < 10)], [-9, -4, 0, 2, 6, 8, 9, 10, 2, 3, 6], [-9, -4, 0, 2, 6, 8, 9]),
        ([l.Squish(10)], range(-4, 16), SQUISHED),
        ([l.Squish(10)], range(-4, 11), list(range(-4, 6))),
        ([l.Squish(10)], range(3), [0, 1, 2]),
        ([l.Fixed(1), l.Squish(2), l.Fixed(2)], range(1, 10), [1, 2, 6, 4, 5]),
        ([l.Fixed(3), l.Fixed(3)], range(1, 5), [1, 2, 3, 4]),
    ],
)
def test_samplers(spark, samplers, items, expected):
    assert value(spark, l.subsample(ints(*items), *samplers)) == expected


def test_split_drops_empty_end(spark):
    got = [value(spark, l.split(F.lit(s), ",")) for s in ("a,b,,", ",,", "", "a", ",a")]
    assert got == [["a", "b"], [], [""], ["a"], ["", "a"]]


def test_zip(spark):
    pair = lambda k, v: F.struct(F.lit(k).alias("_0"), F.lit(v).alias("_1"))
    rows = value(spark, l.zipped(F.array(pair("a", 1), pair("b", 2)), F.array(pair("a", True)), 2, 2))
    assert [tuple(r) for r in rows] == [("a", 1, True), ("b", 2, None)]


def test_stats_and_table(spark):
    s = value(spark, l.stats(ints(1, 3, 5), "bigint"))
    assert (s["average"], s["count"], s["maximum"], s["minimum"], s["sum"]) == (3.0, 3, 5, 1, 9)
    style = l.TableStyle("D ", " DS ", " DE", "H ", " HS ", " HE")
    rows = F.array(F.struct(F.lit(1).alias("a"), F.lit("hi").alias("b")), F.struct(F.lit(2).alias("a"), F.lit("bye").alias("b")))
    text = value(spark, l.table(rows, {"A": lambda r: r["a"], "B": lambda r: r["b"]}, style))
    assert text == "H A HS B HE\nD 1 DS hi DE\nD 2 DS bye DE"


def test_range_and_optima(spark):
    assert value(spark, l.span(F.lit(2), F.lit(2))) == []
    assert value(spark, l.span(F.lit(2), F.lit(5))) == [2, 3, 4]
    assert value(spark, l.maximum(ints(3, 9, 4), lambda v: -v)) == 3
    assert value(spark, l.maximum(F.array().cast("array<int>"), lambda v: v)) is None
    assert value(spark, l.univalued(ints(2, 2))) == 2 and value(spark, l.univalued(ints(2, 3))) is None


def test_division_follows_signs(spark):
    assert value(spark, x.int_div(F.lit(-7), F.lit(2))) == -3
    assert value(spark, x.int_mod(F.lit(-7), F.lit(2))) == -1


def test_date_difference_is_floored(spark):
    a, b = F.timestamp_micros(F.lit(500_000)), F.timestamp_micros(F.lit(1_000_000))
    assert value(spark, x.date_diff(a, b)) == -1 and value(spark, x.date_diff(b, a)) == 0


def test_full_match_and_groups(spark):
    assert value(spark, x.matches(F.lit("abc"), "b")) is False
    assert value(spark, x.matches(F.lit("ABC"), "a.c", "i")) is True
    assert tuple(value(spark, x.capture(F.lit("ab"), "(a)(x)?(b)", 3))) == ("a", None, "b")
    assert value(spark, x.capture(F.lit("zz"), "(a)(x)?(b)", 3)) is None
    # a group that matched the empty string is not one that took no part
    assert tuple(value(spark, x.capture(F.lit("aB"), "(x*)(a)(y)?(b)(z*)", 5, "i"))) == ("", "a", None, "B", "")
    # the match that is found first counts, not another one in which the group takes part
    assert tuple(value(spark, x.capture(F.lit("ab"), "ab|ab()", 1))) == (None,)


def test_padding_never_cuts(spark):
    assert [value(spark, x.pad(F.lit(n), 3)) for n in (7, 1234)] == ["007", "1234"]


@pytest.mark.parametrize(
    "method,mark,expected",
    [
        ("START", "", "abcde"), ("END", "", "fghij"), ("MIDDLE", "", "abij"), ("START_ELLIPSIS", "..", "abc.."),
        ("END_ELLIPSIS", "..", "..hij"), ("MIDDLE_ELLIPSIS", "..", "ab..j"), ("START_ELLIPSIS", "......", "......"),
    ],
)
def test_truncate(spark, method, mark, expected):
    assert value(spark, strings.truncate(F.lit("abcdefghij"), 5, method, mark)) == expected
    assert value(spark, strings.truncate(F.lit("abc"), 5, method, mark)) == "abc"


@pytest.mark.parametrize("text,expected", [("", 0), ("hello", 99162322), ("the quick brown fox", -732416445), ("\U0001F600", 1772899)])
def test_hash(spark, text, expected):
    def java(s):
        h = 0
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    assert value(spark, strings.hash_code(F.lit(text))) == java(text)
    if text in ("", "hello"):
        assert java(text) == expected


def test_paths(spark):
    assert [value(spark, paths.to_path(F.lit(p))) for p in ("/a//b/", "/", "a")] == ["/a/b", "/", "a"]
    assert [value(spark, paths.directory(F.lit(p))) for p in ("/a/b", "/a", "/", "a", "a/b")] == ["/a", "/", None, None, "a"]
    assert [value(spark, paths.file(F.lit(p))) for p in ("/a/b", "/", "a")] == ["b", None, "a"]
    got = [value(spark, paths.normalize(F.lit(p))) for p in ("/a/./b/../c", "/../a", "../a", "a/../../b", "a/..")]
    assert got == ["/a/c", "/a", "../a", "../b", ""]
    pairs = [("/a/b", "/a/b/c/d"), ("/a/b", "/a/x"), ("/a", "/a"), ("a/b", "c")]
    assert [value(spark, paths.relativize(F.lit(a), F.lit(b))) for a, b in pairs] == ["c/d", "../x", "", "../../c"]
    assert value(spark, paths.resolve(F.lit("/a"), F.lit("/b"))) == "/b"
    assert value(spark, paths.ends_with(F.lit("/a/bc"), F.lit("c"))) is False
    assert value(spark, paths.starts_with(F.lit("/ab/c"), F.lit("/a"))) is False
    assert value(spark, paths.change_prefix(F.lit("/a/b"), {"/a/b": "/z"})) == "/z"


def test_parsers(spark):
    v = lambda s: value(spark, strings.parse_version(F.lit(s)))
    assert [tuple(v(s)) if v(s) else None for s in ("1.2", "1.2.3", "1.2.3.4", "1", "1.2.3.4.5")] == [(1, 2, 0), (1, 2, 3), (1, 2, 3), None, None]
    assert [value(spark, strings.parse_lane(F.lit(s))) for s in ("7", "lane_3", "x", "a_b_12")] == [7, 3, 0, 12]
    assert value(spark, strings.first_match(F.lit("ab:cd:ce"), "c.")) == "cd"
    assert [value(spark, numbers.parse_integer(F.lit(s))) for s in ("5", " 5", "-9", "9" * 30, "x")] == [5, None, -9, None, None]
    assert [value(spark, numbers.parse_boolean(F.lit(s))) for s in ("TRUE", "false", "yes")] == [True, False, None]


def test_json(spark):
    field = F.array(F.struct(F.lit('a"b').alias("_0"), F.lit("[1]").alias("_1")))
    assert value(spark, d.obj(field)) == '{"a\\"b":[1]}'
    assert value(spark, d.get(F.lit('{"a": {"b": 1}}'), "a")) == '{"b":1}'
    assert value(spark, d.get(F.lit("[1]"), "a")) == "null"
    assert value(spark, l.from_json(F.lit("[1, \"x\"]"))) == ["1", '"x"']
    assert value(spark, l.from_json(F.lit("5"))) == []


def test_signatures(spark):
    assert value(spark, signatures.sha1([])) == "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"
    df = spark.createDataFrame([("the_foo_study",)], "project string")
    assert df.select(signatures.as_json(["project"])).first()[0] == '{"project":"the_foo_study"}'
    assert signatures.signable_read(["a", "b"], ["b", "c"]) == ["b"]


def test_match_and_order(spark):
    v = x.tagged("A", n=F.lit(3))
    assert value(spark, x.match(v, {"A": lambda t: t["n"] + 1}, F.lit(0))) == 4
    assert tuple(value(spark, x.order(F.lit("b"), F.lit("a")))) == ("a", "b")
    grid = value(spark, x.tabulate(m=[F.lit(5), F.lit(10)]))
    assert grid["m"] == {"0": 5, "1": 10}
    assert value(spark, x.dictionary((F.lit("a"), F.lit(2)), spread=[F.create_map(F.lit("a"), F.lit(1))])) == {"a": 2}


@pytest.mark.parametrize("number,expected", [
    ("NaN", 0), ("Infinity", 2**63 - 1), ("-Infinity", -(2**63)), ("1e30", 2**63 - 1), ("-1e30", -(2**63)), ("-2.9", -2), ("2.9", 2), (None, None),
])
def test_to_integer_never_fails(spark, number, expected):
    assert value(spark, numbers.to_integer(F.lit(number).cast("double"))) == expected


@pytest.mark.parametrize("text,expected", [
    (" 1.5\t\n", 1.5), ("inf", None), ("Infinity", float("inf")), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("", None), ("1 2", None), ("0x1", None), ("nan", None), (None, None),
])
def test_parse_float(spark, text, expected):
    assert value(spark, numbers.parse_float(F.lit(text).cast("string"))) == expected


def test_seconds_beyond_32_bits(spark):
    start = F.timestamp_seconds(F.lit(0))
    assert value(spark, F.unix_seconds(x.date_plus(start, F.lit(3_000_000_000)))) == 3_000_000_000
    assert value(spark, F.unix_seconds(x.date_minus(start, 3_000_000_000))) == -3_000_000_000


def test_empty_cells_and_keys(spark):
    items = ints(1, 2)
    table = l.table(items, {"A": lambda v: F.when(v == 2, v), "B": lambda v: v}, l.MARKDOWN)
    assert value(spark, table).split("\n")[2:] == ["||1|", "|2|2|"]
    assert value(spark, l.dictionary(items, lambda v: F.when(v == 1, F.lit("one")), lambda v: v)) == {"one": 1}


@pytest.mark.parametrize("text, counts", [
    ("y100", (100,)), ("Y*", (masks.ALL,)), ("y*,i8n*,i8,y100", (masks.ALL, None, 8, masks.ALL, 8, None, 100)), ("y5n2,i0,y7", (5, 2, None, None, None, None, 7)),
    ("y5,y7", (5, None, None, None, None, None, 7)), ("y5,n3,i4", (5, None, None, 3, 4)), ("y5i8", (5, None, None, None, 8)), ("y5n2n3n4", (5, 2, None, None, None, 3, None, 4)),
    ("y5,i8i9y3", (5, None, 8, None, 9, None, 3)), ("y5,,,", (5,)), ("y5,,i8", (5, None, None, None, 8)), ("y5,i8,i9,n2", (5, None, 8, None, 9, None, None, 2)),
    *[(x, None) for x in (None, "", "i8", "n5", ",y5", "y", "y5x", "y5,,,,", "y5,y6,y7", "y5,i1,i2,i3", "y5,n2i3i4i5", "y 5", "y5n1n2n3n4", "y5,y6,i3")],
])
def test_masks(spark, text, counts):
    (row,) = spark.createDataFrame([(text,)], "t string").select(masks.parse_mask("t").alias("m")).collect()
    assert row["m"] == (None if counts is None else (*counts, *[None] * (8 - len(counts))))
