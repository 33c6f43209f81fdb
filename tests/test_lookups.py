"""Lookups, sub-groupers and running values against brute force."""

import itertools
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sluice.functions import masks
from sluice.operators import bins
from sluice.operators import collectors as c
from sluice.operators import groupers as g
from sluice.operators import lookups as k
from sluice.operators.ordered import positions

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def plain(ts):
    return ts.replace(tzinfo=None)


@pytest.mark.parametrize("widths", [(), (3600 * 10**6,), (60 * 10**6, 1440), (7 * 10**6, 100, 100)])
def test_asof_over_many_buckets(spark, widths):
    rnd = random.Random(5)
    steps = sorted(rnd.sample(range(0, 20000), 40))
    probes = [rnd.randint(-500, 21000) for _ in range(300)] + steps[:5]
    rows = spark.createDataFrame([(i, at(p)) for i, p in enumerate(probes)], "i int, t timestamp")
    table = spark.createDataFrame([(at(s), f"v{s}") for s in steps], "start timestamp, v string")
    found = k.asof_lookup(rows, "t", table, "start", "v", "v", widths=widths)
    got = {r.i: (plain(r.v_start), r.v) for r in found.collect()}
    for i, p in enumerate(probes):
        before = [s for s in steps if s <= p]
        assert got[i] == ((at(before[-1]), f"v{before[-1]}") if before else (datetime(1970, 1, 1), ""))


@pytest.mark.parametrize("widths", [(), (60 * 10**6, 1440), (7 * 10**6, 100, 100)])
def test_window_membership_is_strict(spark, widths):
    rnd = random.Random(6)
    windows = [(s, s + rnd.randint(0, 600)) for s in (rnd.randint(0, 5000) for _ in range(25))]
    probes = [rnd.randint(-50, 6000) for _ in range(200)] + [w[0] for w in windows] + [w[1] for w in windows]
    rows = spark.createDataFrame([(i, at(p)) for i, p in enumerate(probes)], "i int, t timestamp")
    table = spark.createDataFrame([(at(a), at(b)) for a, b in windows], "a timestamp, b timestamp")
    found = k.window_membership(rows, "t", table, "a", "b", "inside", widths=widths)
    got = {r.i: r.inside for r in found.collect()}
    assert got == {i: any(a < p < b for a, b in windows) for i, p in enumerate(probes)}


def test_wildcards_take_the_first_rule(spark):
    rules = [(0, "a", None, "r0"), (1, None, "x", "r1"), (2, "b", "x", "r2"), (3, "b", None, "r3"), (4, "c", "y", "r4")]
    table = spark.createDataFrame(rules, "line int, p string, q string, v string")
    rows = [(p, q) for p in "abcd" for q in "xyz"]
    df = spark.createDataFrame(rows, "p1 string, q1 string")
    found = k.wildcard_lookup_join(df, table, {"p": "p1", "q": "q1"}, "v", "line", "v", F.lit("none"))
    want = {
        (p, q): next((v for _, rp, rq, v in rules if rp in (None, p) and rq in (None, q)), "none") for p, q in rows
    }
    assert {(r.p1, r.q1): r.v for r in found.collect()} == want
    anything = spark.createDataFrame([(0, None, None, "all")], "line int, p string, q string, v string")
    assert k.wildcard_lookup_join(df, anything, {"p": "p1", "q": "q1"}, "v", "line", "v", F.lit("none")).filter("v = 'all'").count() == 12


def test_equivalence_uses_the_last_line(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "line int, name string")
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("d", "x"), ("a", "c")], "x string, y string")
    found = {(r.x, r.y): r.s for r in k.equivalence_match(df, "x", "y", lines, "name", "line", "s").collect()}
    assert found == {("a", "b"): True, ("b", "a"): False, ("b", "c"): True, ("d", "d"): True, ("d", "x"): False, ("a", "c"): False}


def test_positions(spark):
    df = spark.createDataFrame([("g", i * 7) for i in range(50)] + [("h", 3)], "g string, line long")
    out = {(r.g, r.line): r.p for r in positions(df, ["g"], "line", "p", width=20).collect()}
    assert out == {**{("g", i * 7): i for i in range(50)}, ("h", 3): 0}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], min(row[n] + 1, row[n - 1] + 1, last + (x != y))
    return row[-1]


def hamming(target, other):
    n = min(len(target), len(other))
    return max(len(target) - len(other), 0) + sum(a != b for a, b in zip(target[:n], other[:n]))


@pytest.mark.parametrize("minimum", [1, 2, 4])
def test_near_collisions(spark, minimum):
    rnd = random.Random(minimum)
    codes = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 9))) for _ in range(70)]
    rows = [(i % 2, s) for i, s in enumerate(codes)]
    df = spark.createDataFrame(rows, "g int, s string")
    edits, ordered = {}, {}
    for grp in (0, 1):
        own = [s for n, s in rows if n == grp]
        for a, b in itertools.combinations(own, 2):
            if levenshtein(a, b) < minimum:
                key = (grp, min(a, b), max(a, b))
                edits[key] = edits.get(key, 0) + 1
        for a, b in itertools.permutations(own, 2):
            if hamming(a, b) < minimum:
                ordered[(grp, a, b)] = ordered.get((grp, a, b), 0) + 1
    found = {(r.g, r.code_a, r.code_b): r.n_pairs for r in k.edit_collisions(df, ["g"], "s", minimum).collect()}
    assert found == edits
    found = {(r.g, r.target, r.other): r.n_pairs for r in k.hamming_collisions(df, ["g"], "s", minimum).collect()}
    assert found == ordered


def changed(rng, text, edits):
    for _ in range(edits):
        i = rng.randint(0, len(text))
        text = rng.choice([text[:i] + rng.choice("ACGT") + text[i:], text[: max(i - 1, 0)] + text[i:], text[: max(i - 1, 0)] + rng.choice("ACGT") + text[i:]])
    return text


@pytest.mark.parametrize("lengths, minimum", [((195, 205), 4), ((17, 30), 4), ((4, 9), 2), ((9, 16), 3)])
def test_near_collisions_of_long_codes(spark, lengths, minimum):
    rnd = random.Random(minimum)
    seeds = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(*lengths))) for _ in range(12)]
    codes = seeds + [changed(rnd, rnd.choice(seeds), rnd.randint(1, minimum + 1)) for _ in range(60)]
    codes += ["".join(rnd.choice("ACGT") if rnd.random() < 0.01 else c for c in s) for s in seeds]
    df = spark.createDataFrame([(1, s) for s in codes], "g int, s string")
    edits, ordered = {}, {}
    for a, b in itertools.combinations(codes, 2):
        if abs(len(a) - len(b)) < minimum and levenshtein(a, b) < minimum:
            edits[min(a, b), max(a, b)] = edits.get((min(a, b), max(a, b)), 0) + 1
    for a, b in itertools.permutations(codes, 2):
        if hamming(a, b) < minimum:
            ordered[a, b] = ordered.get((a, b), 0) + 1
    assert {(r.code_a, r.code_b): r.n_pairs for r in k.edit_collisions(df, ["g"], "s", minimum).collect()} == edits
    assert {(r.target, r.other): r.n_pairs for r in k.hamming_collisions(df, ["g"], "s", minimum).collect()} == ordered


def members(long, by="g"):
    """Sorted (group, items of the subgroup) of a long form."""
    found = {}
    for r in long.collect():
        found.setdefault((r[by], str(r["subgroup"])), []).append(r["i"])
    return sorted(((k[0], tuple(sorted(v))) for k, v in found.items()), key=repr)


def test_combinations_of_three(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), ("b", 2)] + [(None, i) for i in (7, 8, 9)], "g string, i int")
    want = [("a", t) for t in itertools.combinations(range(5), 3)] + [(None, (7, 8, 9))]
    assert members(g.combinations(df, ["g"], 3, "i")) == sorted(want, key=repr)


def test_a_crosstab_without_end_is_named(spark):
    df = spark.createDataFrame([("g", v, i) for v in range(64) for i in (0, 1)], "g string, v int, i int")
    with pytest.raises(Exception, match="2\\^63 choices"):
        g.crosstab(df, ["g"], "v", "i").count()


@pytest.mark.parametrize("size, block", [(2, 3), (3, 2), (3, 4), (4, 3)])
def test_combinations_over_block_borders(spark, size, block):
    groups = {"a": 9, None: 5, "b": block, "c": 2}
    df = spark.createDataFrame([(n, 10 * i) for n, many in groups.items() for i in range(many)], "g string, i int")
    want = [(n, t) for n, many in groups.items() for t in itertools.combinations(range(0, 10 * many, 10), size)]
    assert members(g.combinations(df, ["g"], size, "i", block=block)) == sorted(want, key=repr)


def test_one_group_is_spread_over_its_pairs_of_blocks(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(600).select(F.lit("hot").alias("g"), F.col("id").alias("i"))
        made = []

        def seen(a, b, keys, hint=None):
            joined = joins_same(a, b, keys, hint=hint)
            if "__a" in keys:
                made.append(joined.groupBy(F.spark_partition_id().alias("task")).count())
            return joined

        joins_same = g.join_same
        with pytest.MonkeyPatch.context() as m:
            m.setattr(g, "join_same", seen)
            pairs = g.combinations(df, ["g"], 2, "i", block=30)
        tasks = [r["count"] for r in made[0].collect()]
        # 20 blocks make 210 pairs of blocks
        assert len(tasks) > 60 and max(tasks) < sum(tasks) / 10 and pairs.count() == 600 * 599
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_pairs_of_a_large_group(spark):
    df = spark.range(1500).select(F.lit(None).cast("int").alias("g"), F.col("id").alias("i"))
    pairs = g.combinations(df, ["g"], 2, "i", {"total": c.total("i")})
    assert tuple(pairs.agg(F.count("*"), F.sum("total")).first()) == (1500 * 1499 // 2, 1499 * 1499 * 1500 // 2)


def test_crosstab(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("a", None, 4), ("a", None, 5), ("b", "z", 6), (None, "x", 7), (None, "w", 8), (None, "w", 9)]
    df = spark.createDataFrame(rows, "g string, axis string, i int")
    want = [("a", (x, 3, y)) for x in (1, 2) for y in (4, 5)] + [("b", (6,)), (None, (7, 8)), (None, (7, 9))]
    assert members(g.crosstab(df, ["g"], "axis", "i")) == sorted(want, key=repr)
    sums = g.crosstab(df, ["g"], "axis", "i", {"total": c.total("i")}).collect()
    assert sorted(r["total"] for r in sums) == sorted(sum(t) for _, t in want)


@pytest.mark.parametrize("full", [False, True])
def test_powerset(spark, full):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 9), (None, 1), (None, 2)], "g string, i int")
    sets = [(k, t) for k, v in (("a", range(4)), ("b", (9,)), (None, (1, 2))) for n in range(1, len(v) + 1) for t in itertools.combinations(v, n) if full or n < len(v)]
    assert members(g.powerset(df, ["g"], "i", include_full=full)) == sorted(sets, key=repr)


def test_powerset_of_seventeen_rows(spark):
    sizes = g.powerset(spark.range(17).withColumn("g", F.lit(1)), ["g"], "id", {"n": c.count()})
    assert tuple(sizes.agg(F.count("*"), F.sum("n")).first()) == (2**17 - 2, 17 * 2**16 - 17)


def first_fit(costs, limit):
    bins = [[n] for n, v in costs.items() if v >= limit]
    rest = sorted(((v, n) for n, v in costs.items() if v < limit), key=lambda e: (-e[0], e[1]))
    while rest:
        room, taken = limit, []
        for v, n in rest:
            if v <= room:
                taken.append(n)
                room -= v
                if room == 0:
                    break
        bins.append(sorted(taken))
        rest = [e for e in rest if e[1] not in taken]
    return sorted(bins)


def test_greedy_bins(spark):
    rnd = random.Random(8)
    rows = [{f"n{i}": rnd.randint(0, 30) for i in range(rnd.randint(1, 12))} for _ in range(80)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, costs map<string,bigint>")
    out = {r.i: r.b for r in df.select("i", g.greedy_bins("costs", 25).alias("b")).collect()}
    assert out == {i: first_fit(r, 25) for i, r in enumerate(rows)}


def merged_lanes(rows):
    """Expected subgroups of one run: rows are (lane, identifier, weight, merges)."""
    merges = {str(r[3]) for r in rows}
    if len(merges) > 1:
        return {}
    target = {}
    for group in rows[0][3]:
        for lane in group:
            if lane in target:
                return {}
            target[lane] = min(group)
    if not target:
        return {}
    out, lanes, ids = [], None, None
    for lane in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lane]
        found = {r[1] for r in own if r[1] is not None}
        if lane not in target:
            return {}
        if lanes is None or target[lane] not in lanes:
            lanes, ids, weight = [lane], found, [r[2] for r in own]
            out.append((lanes, weight))
        else:
            if found and found != ids:
                return {}
            lanes.append(lane)
            weight += [r[2] for r in own if r[1] is None]
    return {tuple(ls): (len(w), sum(w)) for ls, w in out}


def test_merge_sets(spark):
    rnd = random.Random(11)
    shapes = [[[1, 2], [3, 4]], [[1, 2, 3, 4]], [[1, 3], [2], [4]], [[1], [2], [3], [4]], [[1, 2], [2, 3, 4]], [], [[1, 2, 3]]]
    rows, want = [], {}
    for run in range(150):
        shape = rnd.choice(shapes)
        own = []
        for lane in range(1, 5):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                odd = rnd.random() < 0.03
                own.append((lane, rnd.choice([None, None, "x", "x", "y"]) if rnd.random() < 0.5 else "x", rnd.randint(1, 9), [[1]] if odd else shape))
        rows += [(run, *r) for r in own]
        if own:
            want.update({(run, ls): v for ls, v in merged_lanes(own).items()})
    df = spark.createDataFrame(rows, "run int, lane bigint, id string, w bigint, merges array<array<bigint>>")
    out = g.merge_sets(df, ["run"], "merges", "id", "lane", {"n": c.count(), "w": c.total("w")})
    assert {(r.run, tuple(r.merged_lanes)): (r.n, r.w) for r in out.collect()} == want
    assert len(want) > 50


def test_always_include(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "*", 4), ("a", "*", 8), ("b", "*", 16), ("c", "x", 32)]
    df = spark.createDataFrame(rows, "g string, k string, v int")
    into = {"v": c.total("v"), "always": c.where(F.col("is_always"), c.count()), "ks": c.flattened(F.array("k"))}
    out = g.always_include(df, ["g"], "k", F.lit("*"), into)
    got = sorted((r.g, r.group_key, r.v, r.always, tuple(r.ks)) for r in out.collect())
    assert got == [("a", "x", 13, 2, ("*", "x")), ("a", "y", 14, 2, ("*", "y")), ("c", "x", 32, 0, ("x",))]


def runs_of_codes(spark, rows):
    return spark.createDataFrame(rows, "run string, mask string, codes array<string>")


def test_barcodes(spark):
    m = "y*,i6"
    rows = [
        ("good", m, ["ACGTTT"]), ("good", m, ["TTTAAATA"]), ("close", m, ["CTTTTT"]), ("close", m, ["ATTTTT"]), ("masks", m, ["AAAAAA"]), ("masks", "y*,i8", ["TTTTTT"]),
        ("junk", m, ["ACGX"]), ("junk", m, ["ACGTTT"]), ("nomask", "zz", ["ACGT"]), ("twice", m, ["ACGTAC"]), ("twice", m, ["acgtac"]), ("gone", "y*", ["ACGT"]),
        (None, m, ["AAAAAA"]), (None, m, ["CCCCCC", "GG"]), ("none", m, ["NoIndex"]), ("only", m, []),
    ]
    out = g.barcodes(runs_of_codes(spark, rows), ["run"], "mask", "codes", 2, {
        "n": c.count(), "codes": c.flattened("trimmed_codes"), "mask": c.univalued("new_mask"),
    })
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        ("good", "6", 2, ["ACGTTT", "TTTAAA"], "y*,i6n*"), (None, "6", 2, ["AAAAAA", "CCCCCC"], "y*,i6n*"), (None, "2", 1, ["GG"], "y*,i2n*"),
        ("none", "NoIndex", 1, [""], "y*,n*"),
    ], key=repr)


def test_dual_barcodes(spark):
    m = "y*,i4,i3n2,y9"
    rows = [("a", m, ["ACGTA-TTT"]), ("a", m, ["ACGTA-AAA"]), ("b", m, ["ACGT-TTT"]), ("b", m, ["ACGA-TTA"]), ("c", m, ["ACGT-TTT", "GGGG"]), ("d", m, ["ACGT-TTT", "ACGT"])]
    out = g.barcodes(runs_of_codes(spark, rows), ["run"], "mask", "codes", 3, {"codes": c.flattened("trimmed_codes"), "mask": c.univalued("new_mask")})
    assert sorted(map(tuple, out.collect())) == [
        ("a", "4x3", ["ACGT-AAA", "ACGT-TTT"], "y*,i4n*,i3n2,y9"), ("c", "4", ["GGGG"], "y*,i4n*,n2,y9"), ("c", "4x3", ["ACGT-TTT"], "y*,i4n*,i3n2,y9"),
    ]


def test_masks(spark):
    texts = {
        "y1n1,i1n1,y1n1": "y1n1,i1n1,y1n1", "y*n0,i1n1,y*n0": "y*,i1n1,y*", "Y*,i6n*,y*": "y*,i6n*,y*", "y*,i6n2,i6n2,y*": "y*,i6n2,i6n2,y*",
        "y*n0,i6n0,i6n0": "y*,i6,i6", "y51": "y51", "i6": None, "y": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.w for r in df.select("t", masks.write_mask(masks.parse_mask("t")).alias("w")).collect()} == texts
    segments = df.sparkSession.createDataFrame([("y5n1,I8,i*n2,y7",)], "t string").select(masks.parse_bases_mask("t").alias("s"))
    got = [(s.cycle_end, s.cycle_start, s.group, s.length, s.ordinal, s.position, s.type) for s in segments.first().s]
    assert got == [
        (5, 0, 0, 5, 0, 0, "Y"), (6, 5, 0, 1, 0, 1, "N"), (14, 6, 1, 8, 0, 0, "I"), (-1, 14, 2, -1, 1, 0, "I"), (-1, -1, 2, 2, 1, 1, "N"), (-1, -1, 3, 7, 1, 0, "Y"),
    ]
    assert segments.select(masks.pack_bases_mask(F.transform("s", masks.convert_mask))).first()[0] == "Y5N1,I8,I*N2,Y7"
    cells = spark.range(1).select(masks.flowcell_geometry(F.lit(3), F.lit(True)), masks.flowcell_geometry(F.lit(3), F.lit(False)), masks.is_workflow_type_joined(F.lit("NovaSeqStandard")))
    assert tuple(cells.first()) == ([[1, 2, 3]], [[1], [2], [3]], True)


def test_collisions_of_dual_codes(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("AC", k=n))
    rows = [(rng.choice(["a", None]), word(rng.randrange(2, 5)), rng.choice([None, word(rng.randrange(1, 4))])) for _ in range(40)]

    def distance(x, y):
        y = y[: len(x)]
        return len(x) - len(y) + sum(p != q for p, q in zip(x, y))

    df = spark.createDataFrame(rows, "g string, one string, two string")
    want = set()
    for i, (g1, a, b) in enumerate(rows):
        for j, (g2, x, y) in enumerate(rows):
            if i != j and g1 == g2 and distance(a, x) + distance(b or "", y or "") < 2:
                want.add((g1, "-".join(filter(None, (a, b))), "-".join(filter(None, (x, y)))))
    found = k.hamming_collisions(df, ["g"], "one", 2, "two")
    assert {(r.g, r.target, r.other) for r in found.collect()} == want


def test_repeated_lookup_keys_give_one_row(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "k string, l string")
    table = spark.createDataFrame([("a", "x", 5), ("a", "x", 3), ("ALL", "y", 2), ("ALL", "y", 1)], "t string, u string, v int")
    sets = table.select("t", F.array("u").alias("s"))
    assert {(r.k, tuple(r.s)) for r in k.string_expand(df, "k", sets, "t", "s", "s").collect()} == {("a", ("x",)), ("b", ("b",)), (None, (None,))}
    renamed = df.withColumnsRenamed({"k": "t", "l": "u"})
    assert sorted((str(r.t), r.found) for r in k.fallback_lookup(renamed, table, "t", ["u"], "v", "found").collect()) == [("None", None), ("a", 3), ("b", 1)]
    assert sorted((str(r.k), r.p) for r in k.name_order_lookup(df, "k", "l", table, "t", "u", "v", "p").collect()) == [("None", k.MISSING_POSITION), ("a", 3), ("b", k.MISSING_POSITION)]
    assert sorted((str(r.k), r.n) for r in k.config_lookup(df, "k", table, "t", {"v": "n"}, {"v": F.lit(9)}).collect()) == [("None", 9), ("a", 3), ("b", 9)]


def test_config_lookup(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    table = spark.createDataFrame([("a", 1), ("b", None)], "k2 string, size int")
    filled = k.config_lookup(df, "k", table, "k2", {"size": "size"}, {"size": F.lit(7)})
    strict = k.config_lookup(df, "k", table, "k2", {"size": "size"}, {"size": F.lit(7)}, missing_uses_defaults=False)
    assert sorted(map(tuple, filled.collect())) == [("a", 1), ("b", 7), ("z", 7)]
    assert {r.k: r["size"] for r in strict.collect()} == {"a": 1, "b": 7, "z": None}


def test_utc(spark):
    assert spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("t")).first().t.replace(tzinfo=timezone.utc) is not None


def plain_first_fit(costs, limit):
    rooms, chosen = [], []
    for cost in costs:
        at = next((i for i, room in enumerate(rooms) if room > 0 and room >= cost), len(rooms))
        if at == len(rooms):
            rooms.append(limit)
        rooms[at] -= cost
        chosen.append(at)
    return chosen


def test_first_fit_by_a_tree():
    rnd = random.Random(5)
    for n in range(200):
        limit = rnd.choice([1, 7, 50, 1000])
        costs = sorted((rnd.randint(rnd.choice([-3, 0, min(1, limit - 1)]), limit - 1) for _ in range(rnd.randint(0, 40))), reverse=True)
        assert bins.first_fit(costs, limit) == plain_first_fit(costs, limit), (costs, limit)
    assert bins.first_fit([], 5) == [] and bins.first_fit([-1, -2], 0) == plain_first_fit([-1, -2], 0)


def test_greedy_bins_of_a_large_dictionary(spark):
    rnd = random.Random(6)
    costs = {f"n{i:05d}": rnd.randint(0, 120) for i in range(10_000)}
    df = spark.createDataFrame([(1, costs), (2, None), (3, {})], "i int, costs map<string,int>")
    start = time.perf_counter()
    out = {r.i: r.b for r in df.select("i", g.greedy_bins("costs", 100).alias("b")).collect()}
    assert time.perf_counter() - start < 20
    cheap = sorted(((-v, k) for k, v in costs.items() if v < 100))
    filled = {}
    for (_, name), at in zip(cheap, plain_first_fit([-c for c, _ in cheap], 100)):
        filled.setdefault(at, []).append(name)
    assert out[1] == sorted([*map(sorted, filled.values()), *([k] for k, v in costs.items() if v >= 100)])
    assert out[2] is None and out[3] == []
