"""Lookups against decision, range, schedule and equivalence tables.

Every lookup is an equality join or a bucketed running value, so the lookup
table may be any size; Spark broadcasts it when its measured size is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordered import TIME_WIDTHS, running_at
from sluice.semantics import all_of, bind, col, join_same

MISSING_POSITION = 2**63 - 1


def wildcard_lookup_join(
    df: DataFrame, table: DataFrame, keys: Mapping[str, Column | str], value: str, priority: str,
    name: str, default: Column,
) -> DataFrame:
    """Decision table: the first row whose key columns are equal or empty (``*``).

    One equality join per combination of wildcard columns (at most 2^keys),
    each against rules reduced to one row per exact key, so a hot key of the
    rows only ever meets one rule per combination.
    """
    fields, columns = list(keys), df.columns
    best: list[Column] = []
    for n, wild in enumerate(product([False, True], repeat=len(fields))):
        rules = table.filter(all_of(F.col(f).isNull() if w else F.col(f).isNotNull() for f, w in zip(fields, wild)))
        fixed = [f for f, w in zip(fields, wild) if not w]
        hit = F.min(F.struct(F.col(priority).alias("p"), F.col(value).alias("v"))).alias(f"__hit{n}")
        if not fixed:
            best.append(rules.agg(hit).scalar())
            continue
        rules = rules.groupBy(*[F.col(f).alias(f"__{n}_{f}") for f in fixed]).agg(hit)
        on = all_of(col(keys[f]) == F.col(f"__{n}_{f}") for f in fixed)
        df = df.join(rules, on, "left")
        best.append(F.col(f"__hit{n}"))
    chosen = F.least(*best)["v"] if len(best) > 1 else best[0]["v"]
    return df.select(*columns, F.coalesce(chosen, default).alias(name))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts))


def asof_lookup(
    df: DataFrame, at: str, table: DataFrame, start: str, value: str, name: str,
    by: Mapping[str, str] | None = None, default: str = "", widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """Start and value of the latest window starting at or before a time.

    Before the first window: (epoch, default).  ``by`` maps columns of ``df``
    to columns of ``table`` for a separate axis per key.  Only the distinct
    times are looked up; the rows then join their times.
    """
    by = dict(by or {})
    axes = [f"__by{i}" for i in range(len(by))]
    probes = df.select(*[F.col(k).alias(a) for k, a in zip(by, axes)], micros(at).alias("at")).distinct()
    steps = table.groupBy(*[F.col(k).alias(a) for k, a in zip(by.values(), axes)], F.col(start).alias("start")).agg(
        F.max(F.col(value)).alias("v")
    )
    steps = steps.select(
        *axes, micros("start").alias("at"), F.lit(0).alias("rank"),
        F.struct("start", F.col("v").alias("value")).alias("value"),
    )
    found = running_at(probes.withColumn("rank", F.lit(1)), steps, axes, "last", widths)
    found = found.withColumnsRenamed({"at": "__at", "value": "__found"})
    on = all_of([micros(at) == F.col("__at"), *[F.col(k) == F.col(a) for k, a in zip(by, axes)]])
    out = df.join(found, on, "left")
    return out.select(
        *df.columns,
        F.coalesce(F.col("__found.start"), F.timestamp_seconds(F.lit(0))).alias(f"{name}_start"),
        F.coalesce(F.col("__found.value"), F.lit(default)).alias(name),
    )


def window_membership(
    df: DataFrame, at: str, windows: DataFrame, start: str, end: str, name: str,
    widths: Sequence[int] = TIME_WIDTHS,
) -> DataFrame:
    """Is a time strictly inside any window?

    Counts windows that started before minus windows that ended at or before
    the time, so overlapping windows need no pairing.
    """
    windows = windows.filter(F.col(start) < F.col(end))
    steps = windows.select(micros(start).alias("at"), F.lit(2).alias("rank"), F.lit(1).alias("value")).unionByName(
        windows.select(micros(end).alias("at"), F.lit(0).alias("rank"), F.lit(-1).alias("value"))
    )
    steps = steps.groupBy("at", "rank").agg(F.sum("value").alias("value"))
    probes = df.select(micros(at).alias("at")).distinct().withColumn("rank", F.lit(1))
    open_now = running_at(probes, steps, [], "sum", widths)
    open_now = open_now.select(F.col("at").alias("__at"), F.col("value").alias("__open"))
    out = df.join(open_now, micros(at) == F.col("__at"), "left")
    return out.select(*df.columns, (F.coalesce("__open", F.lit(0)) > 0).alias(name))


def equivalence_match(
    df: DataFrame, a: str, b: str, classes: DataFrame, member: str, line: str, name: str
) -> DataFrame:
    """Are two names equal or in one class?  A name belongs to its last line."""
    listed = classes.select(F.col(line).alias("__line"), F.col(member).alias("__member")).distinct()
    # a class of one says nothing
    sizes = listed.groupBy("__line").count().filter("count > 1").select("__line")
    listed = listed.join(sizes, "__line", "left_semi")
    last = listed.groupBy(F.col("__member").alias("__a")).agg(F.max("__line").alias("__aline"))
    second = listed.select(F.col("__line").alias("__bline"), F.col("__member").alias("__b"))
    out = df.join(last, F.col(a) == F.col("__a"), "left").join(
        second, (F.col("__aline") == F.col("__bline")) & (F.col(b) == F.col("__b")), "left"
    )
    return out.select(*df.columns, ((F.col(a) == F.col(b)) | F.col("__b").isNotNull()).alias(name))


def string_expand(df: DataFrame, text: str, table: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """The set a string stands for, or the set of just itself; a repeated string stands for its smallest set."""
    table = table.groupBy(F.col(key).alias("__key")).agg(F.min(values).alias("__values"))
    out = df.join(table, F.col(text) == F.col("__key"), "left")
    return out.select(*df.columns, F.coalesce("__values", F.array(F.col(text))).alias(name))


def fallback_lookup(
    df: DataFrame, table: DataFrame, first_key: str, other_keys: Sequence[str], value: str, name: str,
    fallback: str = "ALL",
) -> DataFrame:
    """Exact key, else the same key with its first part replaced by a fallback; a repeated key has its smallest value."""
    keys = [first_key, *other_keys]
    exact = table.groupBy(*[F.col(k).alias(f"__x{i}") for i, k in enumerate(keys)]).agg(F.min(value).alias("__exact"))
    general = table.filter(F.col(first_key) == fallback).groupBy(
        *[F.col(k).alias(f"__g{i}") for i, k in enumerate(other_keys)]
    ).agg(F.min(value).alias("__general"))
    out = df.join(exact, all_of(F.col(k) == F.col(f"__x{i}") for i, k in enumerate(keys)), "left")
    out = out.join(general, all_of(F.col(k) == F.col(f"__g{i}") for i, k in enumerate(other_keys)), "left")
    return out.select(*df.columns, F.coalesce("__exact", "__general").alias(name))


def name_order_lookup(
    df: DataFrame, group: str, label: str, table: DataFrame, table_group: str, table_label: str, position: str,
    name: str,
) -> DataFrame:
    """Position of a name in its file (the first, if it is repeated); a missing name sorts last."""
    found = table.groupBy(F.col(table_group).alias("__group"), F.col(table_label).alias("__label")).agg(
        F.min(position).alias("__position")
    )
    out = df.join(found, (F.col(group) == F.col("__group")) & (F.col(label) == F.col("__label")), "left")
    return out.select(*df.columns, F.coalesce("__position", F.lit(MISSING_POSITION)).alias(name))


def config_lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, fields: Mapping[str, str],
    defaults: Mapping[str, Column], missing_uses_defaults: bool = True,
) -> DataFrame:
    """Keyed settings: stored field, else the field's default.

    A key that is not in the table gives the defaults, or empty fields; of
    repeated settings of a key the smallest count, field by field in order.
    """
    row = F.min(F.struct(*[F.col(f).alias(f"__{f}") for f in fields]))
    stored = table.groupBy(F.col(table_key).alias("__key")).agg(row.alias("__row")).select("__key", "__row.*")
    out = df.join(stored, F.col(key) == F.col("__key"), "left")
    known = F.col("__key").isNotNull()

    def value(f: str) -> Column:
        filled = F.coalesce(F.col(f"__{f}"), defaults[f]) if f in defaults else F.col(f"__{f}")
        return filled if missing_uses_defaults else F.when(known, filled)

    return out.select(*df.columns, *[value(f).alias(n) for f, n in fields.items()])


def _variants(text: Column, rounds: int, shorten) -> Column:
    """Texts reached in up to ``rounds`` single-character steps (itself included)."""

    def grow(state: Column, left: int) -> Column:
        if not left:
            return state["seen"]
        steps = F.flatten(F.transform(state["last"], shorten))
        return bind(
            bind(F.array_distinct(steps), lambda new: F.struct(F.array_union(state["seen"], new).alias("seen"), new.alias("last"))),
            lambda following: grow(following, left - 1),
        )

    start = F.struct(F.array(text).alias("seen"), F.array(text).alias("last"))
    return bind(start, lambda state: grow(state, rounds))


def _without_one(text: Column) -> Column:
    """The text with each single character removed."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array())
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _masked(text: Column, marks: int) -> Column:
    """The text with every choice of ``marks`` characters replaced by a mark."""
    mark = "\1"

    def put(left: int):
        """Mask one more place after the last one, leaving room for the rest."""

        def after(state: Column) -> Column:
            places = F.sequence(state["next"], F.length(state["t"]) - (left - 1))
            return F.transform(
                places,
                lambda i: F.struct(
                    F.overlay(state["t"], F.lit(mark), i, F.lit(1)).alias("t"), (i + 1).alias("next")
                ),
            )

        return after

    def every(t: Column) -> Column:
        states = F.array(F.struct(t.alias("t"), F.lit(1).alias("next")))
        for left in range(marks, 0, -1):
            states = F.flatten(F.transform(states, put(left)))
        chosen = F.transform(states, lambda s: s["t"])
        return F.when(F.length(t) > marks, chosen).otherwise(F.array(F.repeat(F.lit(mark), F.length(t))))

    return bind(text, every)


#: Codes of up to so many characters for each of e + 1 parts meet by deletions or masks, longer ones by a part they share.
SHORT = 6


def _span(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Where part i of a text begins (from 0), and its length."""
    begin = F.floor(i * length / parts).cast("int")
    return begin, (F.floor((i + 1) * length / parts).cast("int") - begin)


def _parts(text: Column, edits: int) -> Column:
    """The text in e + 1 parts, each named by the text's length and its number."""

    def part(i: Column) -> Column:
        begin, size = _span(F.length(text), i, edits + 1)
        return F.concat_ws("\2", F.length(text), i, F.substring(text, begin + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), part)


def _places(text: Column, edits: int) -> Column:
    """What a text has where a part of a text at most e shorter may stand in it, at most e places aside, so named."""

    def part(length: Column, i: Column) -> Column:
        begin, size = _span(length, i, edits + 1)
        fits = F.filter(F.sequence(begin - edits, begin + edits), lambda at: (at >= 0) & (at + size <= F.length(text)))
        return F.transform(fits, lambda at: F.concat_ws("\2", length, i, F.substring(text, at + 1, size)))

    def parts(length: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: part(length, i)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.length(text) - edits, F.length(text)), parts)))


def _codes(df: DataFrame, group: Sequence[str], code: str) -> DataFrame:
    return df.groupBy(*group, F.col(code).alias("__code")).agg(F.count(F.lit(1)).alias("__n"))


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    # both sides are exploded, so their planned sizes say nothing: never broadcast
    return join_same(a, b, keys, hint="merge")


def _closer(pairs: DataFrame, distance: Column, minimum: int) -> DataFrame:
    """Measure each pair once, after repeated meetings were folded."""
    measured = pairs.withColumn("distance", F.when(F.col("n_pairs") > 0, distance))
    return measured.filter(F.col("distance") < minimum)


def edit_collisions(df: DataFrame, group: Sequence[str], code: str, minimum: int) -> DataFrame:
    """Codes of a group closer than ``minimum`` by Levenshtein distance.

    One row per unordered pair of distinct codes (``code_a < code_b``), or per
    repeated code, with the distance and the number of row pairs.  Candidates
    meet in an equality join.  Short texts within e edits become equal after at
    most e deletions from each.  Of a long text cut into e + 1 parts, e edits
    leave one whole, and it stands in the other text at most e places aside, so
    a code has some (e + 1)^3 keys however long it is.
    """
    codes, edits = _codes(df, group, code), minimum - 1
    text, short = F.col("__code"), SHORT * minimum
    nothing = F.array().cast("array<string>")

    def keyed(long: Column) -> Column:
        # pairs whose longer text is short meet by deletions, all others by parts
        left = F.when(F.length(text) <= short, _variants(text, edits, _without_one)).otherwise(nothing)
        return codes.withColumn("__t", F.explode(F.concat(left, F.when(F.length(text) > short - edits, long).otherwise(nothing))))

    other = keyed(_places(text, edits)).withColumnsRenamed({"__code": "__other", "__n": "__m"})
    pairs = _met(keyed(_parts(text, edits)), other, [*group, "__t"]).filter(text != F.col("__other"))
    pairs = pairs.groupBy(*group, F.least(text, F.col("__other")).alias("code_a"), F.greatest(text, F.col("__other")).alias("code_b")).agg(
        F.max(F.col("__n") * F.col("__m")).alias("n_pairs")
    )
    pairs = _closer(pairs, F.levenshtein("code_a", "code_b"), minimum)
    repeats = codes.filter((F.col("__n") > 1) & F.lit(minimum > 0)).select(
        *group, F.col("__code").alias("code_a"), F.col("__code").alias("code_b"),
        F.expr("__n * (__n - 1) div 2").alias("n_pairs"), F.lit(0).alias("distance"),
    )
    return pairs.unionByName(repeats)


def truncated_hamming(target: Column, other: Column) -> Column:
    """Mismatches over the shorter length, plus what the target has left over.

    A longer ``other`` is cut to the target; a longer target counts its excess.
    """
    width = F.least(F.length(target), F.length(other))
    mismatches = F.aggregate(
        F.sequence(F.lit(0), F.greatest(width, F.lit(0))),
        F.lit(0),
        lambda n, i: n + F.when((i > 0) & (F.substring(target, i, F.lit(1)) != F.substring(other, i, F.lit(1))), 1).otherwise(0),
    )
    return F.greatest(F.length(target) - F.length(other), F.lit(0)) + mismatches


def hamming_collisions(df: DataFrame, group: Sequence[str], code: str, minimum: int, second: str | None = None) -> DataFrame:
    """Ordered (target, other) codes of a group closer than ``minimum``.

    Codes that differ in at most e places over a common width become equal
    once the same e places are masked, which gives the equality join; over a
    long width they share one of its e + 1 parts instead.  Only widths that are the length of some code of the group matter.  With a
    ``second`` part (which may be empty) distances and widths are per part, and
    codes are written with a dash.
    """
    edits = minimum - 1
    part_two = F.coalesce(F.col(second), F.lit("")) if second else F.lit("")
    codes = df.groupBy(*group, F.col(code).alias("__one"), part_two.alias("__two")).agg(F.count(F.lit(1)).alias("__n"))
    # no more lengths than the longest code has characters
    lengths = codes.groupBy(*group).agg(F.collect_set(F.length("__one")).alias("__ones"), F.collect_set(F.length("__two")).alias("__twos"))
    codes = join_same(codes, lengths, list(group)).withColumn("__code", F.struct("__one", "__two"))

    def masked(slack: int | None, name: str, count: str) -> DataFrame:
        shaped = codes.withColumn("__w1", F.explode(F.filter("__ones", lambda n: n <= F.length("__one"))))
        shaped = shaped.withColumn("__w2", F.explode(F.filter("__twos", lambda n: n <= F.length("__two"))))
        if slack is not None:
            shaped = shaped.filter(F.length("__one") + F.length("__two") - F.col("__w1") - F.col("__w2") <= slack)
        cut = F.expr("concat(substring(__one, 1, __w1), substring(__two, 1, __w2))")
        return shaped.select(
            *group, F.col("__code").alias(name), F.col("__n").alias(count), "__w1", "__w2",
            F.explode(F.when(F.length(cut) > SHORT * minimum, _parts(cut, edits)).otherwise(_masked(cut, edits))).alias("__t"),
        )

    pairs = _met(masked(edits, "target", "__tn"), masked(None, "other", "__on"), [*group, "__w1", "__w2", "__t"])
    row_pairs = F.when(F.col("target") == F.col("other"), F.col("__tn") * (F.col("__tn") - 1)).otherwise(
        F.col("__tn") * F.col("__on")
    )
    pairs = pairs.groupBy(*group, "target", "other").agg(F.max(row_pairs).alias("n_pairs"))
    distance = truncated_hamming(F.col("target.__one"), F.col("other.__one")) + truncated_hamming(F.col("target.__two"), F.col("other.__two"))
    written = lambda c: F.concat_ws("-", F.col(f"{c}.__one"), F.nullif(F.col(f"{c}.__two"), F.lit(""))).alias(c)
    close = _closer(pairs, distance, minimum)
    return close.select(*group, written("target"), written("other"), "n_pairs", "distance")
