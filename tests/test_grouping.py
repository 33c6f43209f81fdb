"""Collectors, reject streams, picks and joins on small rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import clauses as q
from sluice.operators import collectors as c
from sluice.operators import joins as j
from sluice.operators.grouping import group_by, group_by_with_rejects, pick_max


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        [("1", "/foo1", 3, "SlowA", "the_foo_study", 307), ("2", "/foo2", 3, "SlowA", "the_foo_study", 300)],
        "accession string, path string, file_size long, workflow string, project string, library_size long",
    )


@pytest.fixture(scope="module")
def inner(spark):
    return spark.createDataFrame([(300, "a"), (307, "b")], "l long, s string")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2), ("c", None)], "g string, v long")


def test_optima_defaults(runs):
    one = group_by(runs, ["project"], {"z": c.maximum("library_size", default=F.lit(5))})
    two = group_by(runs, ["project"], {"z": c.maximum("library_size", default=F.lit(999))})
    low = group_by(runs, ["project"], {"z": c.minimum("library_size", default=F.lit(5))})
    assert [got(x, "z") for x in (one, two, low)] == [[(307,)], [(999,)], [(5,)]]


def test_common_where_keeps_the_group(runs):
    out = group_by(runs, ["project"], {"n": c.count(), "none": c.any_match(F.lit(True))}, where=F.col("library_size") > 1000)
    assert got(out, "n", "none") == [(0, False)]


def test_matches_of_an_empty_group(runs):
    into = {"any": c.any_match(F.lit(True)), "all": c.all_match(F.lit(False)), "none": c.none_match(F.lit(True)), "sum": c.total("library_size")}
    out = group_by(runs, ["project"], into, where=F.lit(False))
    assert got(out, "any", "all", "none", "sum") == [(False, True, True, 0)]


def test_rejected_groups_show_only_keys(runs):
    good, bad = group_by_with_rejects(runs, ["project"], {"size": c.univalued("library_size")})
    assert got(good) == [] and got(bad) == [("the_foo_study",)]


@pytest.mark.parametrize(
    "mode,expected",
    [
        (c.drop_empty, [("a", 1), ("b", 4), ("c", 0)]),
        (c.only_if_all, [("a", None), ("b", 4), ("c", None)]),
        (c.only_if_any, [("a", 1), ("b", 4), ("c", None)]),
        (c.require_all, [("b", 4)]),
        (c.require_any, [("a", 1), ("b", 4)]),
    ],
)
def test_optional_modes(gaps, mode, expected):
    out = group_by(gaps, ["g"], {"v": mode(["v"], c.total("v"))})
    assert sorted(((r.g, r.v) for r in out.collect()), key=lambda r: r[0]) == expected


def test_null_key_is_a_group(gaps):
    assert group_by(gaps, ["v"], {"n": c.count()}).filter("v IS NULL").first()["n"] == 2


def test_list_keeps_one_empty(gaps):
    out = group_by(gaps, ["g"], {"v": c.listing("v", keep_empty=True)})
    assert {r.g: r.v for r in out.collect()} == {"a": [None, 1], "b": [2], "c": [None]}


def test_keyed_collectors_beside_plain_ones(gaps):
    rows = gaps.withColumn("items", F.array("g", F.lit("z")))
    into = {"n": c.count(), "d": c.dictionary("g", F.coalesce("v", F.lit(9))), "items": c.flattened("items")}
    out = {r.g: (r.n, r.d, r["items"]) for r in group_by(rows, ["g"], into).collect()}
    assert out == {"a": (2, {"a": 1}, ["a", "z"]), "b": (2, {"b": 2}, ["b", "z"]), "c": (1, {"c": 9}, ["c", "z"])}


def test_empty_input(gaps):
    assert got(group_by(gaps.filter("false"), ["g"], {"n": c.count(), "f": c.flattened(F.array("g"))})) == []


def test_pick_ties(gaps):
    ranked = gaps.withColumn("id", F.monotonically_increasing_id())
    picked = pick_max(ranked.fillna(0), "v", ["g"], ["id"])
    assert [r.g for r in picked.orderBy("g").collect()] == ["a", "b", "c"]


def test_guard(runs, inner):
    assert q.check_guard(runs, inner, c.count(), lambda n: n == 2).count() == 2
    assert q.check_guard(runs, inner, c.count(), lambda n: n > 2).count() == 0
    assert q.check_guard(runs, inner, c.univalued("s"), lambda s: s == "a").count() == 0


def test_join_and_prefix(runs, inner):
    assert got(j.join(runs, inner, "library_size", "l"), "accession", "s") == [("1", "b"), ("2", "a")]
    twice = j.join(runs, runs, "accession", "o_accession", prefix="o_")
    assert twice.count() == 2
    with pytest.raises(ValueError):
        j.join(runs, runs, "accession", "accession")


def test_left_join_semantics(spark, inner):
    left = spark.createDataFrame([(1, 300), (1, 300), (2, 307), (3, 5)], "k long, size long")
    counted = j.left_join(left, inner, "size", "l", {"n": c.count(), "ss": c.listing("s")})
    assert got(counted, "k", "n") == [(1, 1), (1, 1), (2, 1), (3, 0)]
    # a failing collector drops the row
    assert got(j.left_join(left, inner, "size", "l", {"s": c.univalued("s")}), "k", "s") == [(1, "a"), (1, "a"), (2, "b")]
    read = j.left_join(left, inner, F.lit(1), F.lit(1), {"n": c.count()}, where=F.col("l") > F.col("size"), reads=["size"])
    assert got(read, "k", "n") == [(1, 1), (1, 1), (2, 0), (3, 2)]


def test_optional_join_keys(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i long, k string")
    b = spark.createDataFrame([(7, None), (8, "x")], "o long, m string")
    assert got(j.join(a, b, "k", "m"), "i", "o") == [(2, 8)]
    assert got(j.join(a, b, "k", "m", optional_keys=True), "i", "o") == [(1, 7), (2, 8)]


def test_intersection_joins_by_brute_force(spark):
    rnd = random.Random(3)
    sets = [[rnd.choice([None, *range(9)]) for _ in range(rnd.randint(0, 5))] for _ in range(60)]
    left = [(i, s) for i, s in enumerate(sets[:30])]
    right = [(i, s) for i, s in enumerate(sets[30:])]
    ldf = spark.createDataFrame(left, "i int, a array<int>")
    rdf = spark.createDataFrame(right, "o int, b array<int>")
    want = sorted((i, o) for (i, a), (o, b) in itertools.product(left, right) if set(a) & set(b))
    assert got(j.intersection_join(ldf, rdf, "a", "b"), "i", "o") == want
    assert got(j.intersection_join(ldf, rdf, "a", "b", left_id=["i"], right_id=["o"]), "i", "o") == want
    into = {"n": c.count(), "os": c.listing("o")}
    expected = sorted((i, sum(1 for x, _ in want if x == i)) for i, _ in left)
    assert got(j.left_intersection_join(ldf, rdf, "a", "b", into), "i", "n") == expected
    by_id = j.left_intersection_join(ldf, rdf, "a", "b", into, left_id=["i"], right_id=["o"])
    assert got(by_id, "i", "n") == expected
    later = j.left_intersection_join(ldf, rdf, "a", "b", {"n": c.count()}, where=F.col("o") > F.col("i"), reads=["i"])
    assert got(later, "i", "n") == sorted((i, sum(1 for x, o in want if x == i and o > i)) for i, _ in left)


def test_reject_and_require(gaps):
    seen = []
    kept, rejected = q.reject(gaps, F.col("v") > 1, seen.append)
    assert (kept.count(), rejected.count(), len(seen)) == (3, 2, 1)
    kept, rejected = q.require(gaps, "w", F.col("v"))
    assert (kept.count(), rejected.count()) == (3, 2)


def test_gang_text(spark):
    gangs = q.Gangs(g=["a", ("b", ""), "n"])
    df = spark.createDataFrame([("x", "", 1), ("x", "y", 2)], "a string, b string, n long")
    assert got(df.select(gangs.text("g"))) == [("x_1",), ("x_y_2",)]


def test_extract_rules_need_the_same_columns(runs):
    with pytest.raises(ValueError):
        q.extract_rules(runs, [(None, ["project"]), (None, ["workflow"])])


def test_univalued_counts_empties(gaps):
    assert got(group_by(gaps, ["g"], {"v": c.univalued("v")})) == [("b", 2)]
    assert got(group_by(gaps, ["g"], {"v": c.drop_empty(["v"], c.univalued("v"))})) == [("a", 1), ("b", 2)]
    assert got(group_by(gaps, ["g"], {"v": c.univalued("v", default=F.lit(-1))})) == [("a", -1), ("b", 2), ("c", -1)]


def test_dictionary_leaves_out_empty_keys(spark):
    df = spark.createDataFrame([("a", "k", 2), ("a", "k", 1), ("a", None, 3), ("b", None, 4)], "g string, k string, v int")
    assert {r.g: r.d for r in group_by(df, ["g"], {"d": c.dictionary("k", "v")}).collect()} == {"a": {"k": 1}, "b": {}}


def test_keyed_and_plain_collectors_in_one_read(spark, tmp_path):
    spark.createDataFrame([(g, i % 3, ["x", str(i)]) for g in "ab" for i in range(50)], "g string, k int, l array<string>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = group_by(df, ["g"], {"n": c.count(), "ks": c.listing("k"), "ls": c.flattened("l"), "d": c.dictionary("k", F.lit(1)), "top": c.maximum("k")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 + plan.count("Initial Plan")
    assert [(r.g, r.n, r.ks, len(r.ls), r.d, r.top) for r in out.orderBy("g").collect()] == [(g, 50, [0, 1, 2], 51, {0: 1, 1: 1, 2: 1}, 2) for g in "ab"]


def test_always_include_with_empty_keys(spark):
    from sluice.operators.groupers import always_include

    df = spark.createDataFrame([("a", None), ("a", 1), ("a", 0), (None, 1), (None, 0), (None, 0)], "g string, k int")
    out = always_include(df, ["g"], "k", F.lit(0), {"n": c.count()})
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", None, 2), ("a", 1, 2), (None, 1, 3)], key=repr)


def test_merge_sets_rejects_clashes_in_empty_groups(spark):
    from sluice.operators.groupers import merge_sets

    rows = [(None, 1, "x"), (None, 2, "y"), ("a", 1, "x"), ("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, lane long, s string").withColumn("p", F.array(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    out = merge_sets(df, ["g"], "p", "s", "lane", {"n": c.count()})
    assert [(r.g, r.merged_lanes, r.n) for r in out.collect()] == [("a", [1, 2], 2)]


def test_group_tables_and_samplers(spark):
    from sluice.functions.lists import WIKI
    from sluice.operators.grouped_lists import Spread, Take, sample_rows, table_lines

    df = spark.createDataFrame([("a", i) for i in range(-4, 16)] + [(None, i) for i in (3, 1, 2)], "g string, i long")
    lines = table_lines(df, ["g"], "i", {"I": F.col("i"), "None": F.when(F.col("i") > 1, F.lit("x"))}, WIKI)
    assert [r.text for r in lines.filter("g IS NULL").orderBy("line").collect()] == ["||I||None||", "|1||", "|2|x|", "|3|x|"]
    even = sample_rows(df, ["g"], "i", Spread(10))
    assert [r.i for r in even.filter("g = 'a'").orderBy("i").collect()] == list(range(-4, 16, 2))
    assert even.filter("g IS NULL").count() == 3
    both = sample_rows(df, ["g"], "i", Take(8, F.col("i") < 2), Take(3), Take(100))
    assert [(r.i, r.sampled) for r in both.filter("g = 'a'").orderBy("sampled", "i").collect()] == [
        *[(i, 0) for i in range(-4, 2)], *[(i, 1) for i in (2, 3, 4)], *[(i, 2) for i in range(5, 16)],
    ]


def test_keyed_collectors_over_merged_lanes(spark):
    from sluice.operators.groupers import merge_sets

    rows = [("a", 1, "x", 5, "v"), ("a", 2, None, 3, "v"), ("a", 2, None, 4, "w"), ("a", 3, None, 9, "v")]
    df = spark.createDataFrame(rows, "g string, lane long, s string, n int, t string").withColumn("p", F.array(F.array(*[F.lit(i).cast("bigint") for i in (1, 2)]), F.array(F.lit(3).cast("bigint"))))
    out = merge_sets(df, ["g"], "p", "s", "lane", {"ts": c.listing("t"), "all": c.lexical_concat("t", ","), "d": c.dictionary("t", "n"), "n": c.count()})
    found = {tuple(r.merged_lanes): (r.ts, r["all"], r.d, r.n) for r in out.collect()}
    assert found == {(1, 2): (["v", "w"], "v,w", {"v": 3, "w": 4}, 3), (3,): (["v"], "v", {"v": 9}, 1)}


def test_powerset_of_a_large_group_is_an_error(spark):
    from sluice.operators.groupers import powerset

    for size in (63, 64, 65):
        rows = spark.range(size).selectExpr("1 AS g", "id")
        with pytest.raises(Exception, match="63 rows or more"):
            powerset(rows, ["g"], "id").count()


def test_tasks_after_a_shuffle_are_bounded_unless_the_session_says_how(spark):
    from sluice.semantics import pin_session

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    fresh = spark.newSession()
    assert fresh.conf.get(name, None) is None
    assert pin_session(fresh).conf.get(name) == "16m"
    own = spark.newSession()
    own.conf.set(name, "8m")
    assert pin_session(own).conf.get(name) == "8m"


def test_merge_sets_sorts_the_lanes_of_a_task_once(spark, capsys):
    import random

    from sluice.operators.groupers import merge_sets

    rng = random.Random(5)
    sets = [[1, 2], [4, 5, 6]]
    rows = [(rng.choice([None, *range(60)]), rng.choice([1, 2, 4, 5, 6]), rng.choice([None, None, None, "a", "b"])) for _ in range(220)]
    df = spark.createDataFrame([(g, x, s, sets) for g, x, s in rows], "g int, lane int, s string, p array<array<int>>")
    out = merge_sets(df, ["g"], "p", "s", "lane", {"n": c.count()})
    out.explain()
    assert capsys.readouterr().out.count(" Sort [") == 1
    expected = []
    for g in {g for g, _, _ in rows}:
        own = [(x, s) for h, x, s in rows if h == g]
        lanes = sorted({x for x, _ in own})
        ids = {x: {s for y, s in own if y == x and s} for x in lanes}
        heads = {}
        for x in lanes:
            run = next(m for m in sets if x in m)
            heads[x] = run[0] if run[0] in lanes and all(y in run for y in lanes if run[0] <= y <= x) else x
        if any(heads[x] != x and ids[x] and ids[x] != ids[heads[x]] for x in lanes):
            continue
        for h in set(heads.values()):
            members = [x for x in lanes if heads[x] == h]
            n = sum(1 for x, s in own if x in members and (x == h or s is None))
            expected.append((-1 if g is None else g, members, n))
    found = [(-1 if r["g"] is None else r["g"], r["merged_lanes"], r["n"]) for r in out.collect()]
    assert sorted(found) == sorted(e for e in expected if e[2])
