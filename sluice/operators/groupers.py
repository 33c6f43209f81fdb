"""Sub-groupers: split every group into (possibly overlapping) subgroups.

The combinatorial groupers give a *long form*: one row per member of a subgroup
(group keys, ``subgroup``, the row).  Rows are numbered within their group, a
subgroup is a choice of numbers, and members are found by number in an equality
join, so no group or subgroup is gathered; with collectors, long rows are
reduced per subgroup.  Group keys may be empty optionals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.masks import code_length, narrowed_mask, parse_code, parse_mask, trim_code, write_code, write_mask
from sluice.operators.bins import packed
from sluice.operators.collectors import Collector, listing
from sluice.operators.grouping import Keys, finish, group_by, merge_partials, part_labels, partials
from sluice.operators.lookups import hamming_collisions
from sluice.operators.ordered import positions
from sluice.semantics import as_set, bind, col, cut_lineage, join_same, same

# subgroup numbers are made in two steps of this many, so that no array holds them all
_STEP = 1 << 16


def always_include(
    df: DataFrame, by: Keys, key: Column | str, include_when: Column, into: Mapping[str, Collector]
) -> DataFrame:
    """One subgroup per key; rows whose key is ``include_when`` join every subgroup.

    An empty key is a key like others, and ``include_when`` may be empty.  Collectors may read ``is_always``.  The replicated rows are reduced to
    partial results once per group, and only those are handed to subgroups.
    """
    names = list(by)
    if not names:
        raise ValueError("subgroups need at least one grouping key")
    df = df.withColumns(by) if isinstance(by, Mapping) else df
    df = df.withColumn("group_key", col(key))
    own = partials(df.filter(~same("group_key", include_when)).withColumn("is_always", F.lit(False)), [*names, "group_key"], into)
    shared = partials(df.filter(same("group_key", include_when)).withColumn("is_always", F.lit(True)), names, into)
    subgroups = own.select(*names, "group_key").distinct()
    copies = join_same(subgroups, shared, names)
    together = merge_partials(own.unionByName(copies), [*names, "group_key"], into)
    parts, ok, out = finish(together, [*names, "group_key"], into)
    return parts.filter(ok).select(*out)


def _subgroups(chosen: DataFrame, rows: DataFrame, keys: Sequence[str], by: Sequence[str], into: Mapping[str, Collector] | None) -> DataFrame:
    """Chosen members (group, subgroup, number) with their rows, reduced if there are collectors."""
    long = join_same(chosen, rows, keys).drop(*[k for k in keys if k not in by])
    return long if into is None else group_by(long, [*by, "subgroup"], into)


def _numbers(df: DataFrame, last: Column) -> DataFrame:
    """The rows, once for every ``subgroup`` from 0 to below ``last``."""
    zero = F.lit(0).cast("bigint")
    high = df.withColumn("__high", F.explode(F.sequence(zero, F.shiftright(last - 1, 16))))
    low = F.explode(F.sequence(zero, F.least(F.lit(_STEP - 1).cast("bigint"), last - 1 - F.col("__high") * _STEP)))
    return high.withColumn("__low", low).withColumn("subgroup", F.col("__high") * _STEP + F.col("__low")).drop("__high", "__low")


def combinations(
    df: DataFrame, by: Sequence[str], size: int, order: str, into: Mapping[str, Collector] | None = None, block: int = 1024
) -> DataFrame:
    """Every combination of ``size`` rows of a group; ``subgroup`` lists their numbers.

    ``order`` is a unique integer within a group.  Combinations grow by
    equality joins with increasing numbers.  Numbers are cut into blocks, and
    the key is (group, block of the last number, block of the next), so that a
    large group is spread over its pairs of blocks; a row is sent once for each
    block it may meet.
    """
    by = list(by)
    rows = positions(df, by, order, "__number")
    numbers = rows.select(*by, "__number", F.floor(F.col("__number") / block).alias("__b"))
    last = df.groupBy(*by).agg(F.floor((F.count(F.lit(1)) - 1) / block).alias("__last"))
    zero = F.lit(0).cast("bigint")
    others = numbers.select(*by, "__number", F.explode(F.sequence(zero, F.col("__b"))).alias("__a"), "__b")
    found = numbers.select(*by, F.array("__number").alias("subgroup"), F.col("__b").alias("__a"))
    for _ in range(size - 1):
        sent = join_same(found, last, by).select(*by, "subgroup", "__a", F.explode(F.sequence("__a", "__last")).alias("__b"))
        wider = join_same(sent, others, [*by, "__a", "__b"], hint="merge").filter(F.element_at("subgroup", -1) < F.col("__number"))
        found = wider.select(*by, F.array_append("subgroup", F.col("__number")).alias("subgroup"), F.col("__b").alias("__a"))
    chosen = found.select("*", F.explode("subgroup").alias("__number"))
    return _subgroups(chosen, rows, [*by, "__number"], by, into)


def crosstab(df: DataFrame, by: Sequence[str], partition: str, order: str, into: Mapping[str, Collector] | None = None) -> DataFrame:
    """Every choice of one row from each partition value present in a group.

    A subgroup's number, written in the mixed radix of the counts of rows per
    value, gives the number of the row to take from each value.  ``order`` is a
    unique integer within a group and value; an empty value is a value.  A group
    with 2^63 choices or more is an error.
    """
    by = list(by)
    rows = positions(df.withColumn("__value", F.col(partition)), [*by, "__value"], order, "__number")
    counts = df.groupBy(*by, F.col(partition).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    # one entry per value, and every value with two rows doubles the result
    listed = F.sort_array(F.collect_list(F.struct("__value", "__n")))

    def widen(state: Column, x: Column) -> Column:
        axis = F.struct(state["ways"].alias("stride"), x["__n"].alias("n"), x["__value"].alias("value"))
        ways = F.coalesce(F.try_multiply(state["ways"], x["__n"]), F.raise_error(F.lit("crosstab: a group has 2^63 choices or more")).cast("bigint"))
        return F.struct(ways.alias("ways"), F.array_append(state["axes"], axis).alias("axes"))

    groups = counts.groupBy(*by).agg(listed.alias("__listed"))
    start = F.struct(
        F.lit(1).cast("bigint").alias("ways"),
        F.slice(F.transform("__listed", lambda x: F.struct(F.lit(0).cast("bigint").alias("stride"), x["__n"].alias("n"), x["__value"].alias("value"))), 1, 0).alias("axes"),
    )
    groups = groups.select(*by, F.aggregate("__listed", start, widen).alias("__all"))
    numbered = _numbers(groups, F.col("__all.ways")).select(*by, "subgroup", F.explode("__all.axes").alias("__axis"))
    chosen = numbered.select(*by, "subgroup", F.col("__axis.value").alias("__value"), F.expr("(subgroup div __axis.stride) % __axis.n").alias("__number"))
    return _subgroups(chosen, rows, [*by, "__value", "__number"], by, into)


def powerset(df: DataFrame, by: Sequence[str], order: str, into: Mapping[str, Collector] | None = None, include_full: bool = False) -> DataFrame:
    """Every non-empty proper subset of a group (optionally the whole group too).

    Bit i of ``subgroup`` tells whether row i is a member; ``order`` is a unique
    integer within a group.  A group of 63 rows or more is an error.
    """
    by = list(by)
    rows = positions(df, by, order, "__number")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ways = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__n").cast("int"))
    last = F.when(F.col("__n") < 63, ways).otherwise(F.raise_error(F.lit("powerset: a group has 63 rows or more"))) - (0 if include_full else 1)
    sets = _numbers(sizes.filter((F.col("__n") > 1) | F.lit(include_full)), last).filter("subgroup > 0")
    bits = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1), lambda i: F.getbit(F.col("subgroup"), i.cast("int")) == 1)
    chosen = sets.select(*by, "subgroup", F.explode(bits).alias("__number"))
    return _subgroups(chosen, rows, [*by, "__number"], by, into)


def merge_sets(
    df: DataFrame, by: Sequence[str], permitted: str, identifier: str, lane: str, into: Mapping[str, Collector]
) -> DataFrame:
    """Collapse lanes that may be merged into subgroups; a conflict rejects the group.

    ``permitted`` is an array of arrays of lanes, the same on every row of the
    group.  A lane joins the subgroup of the smallest lane of its set if that
    lane and all lanes between them went there; its identifiers must then be
    none, or those of that first lane.  Rows of joining lanes that carry an
    identifier stay out.

    The rows are read and reduced once, per lane and per whether they are
    identified; everything after that works on lanes, under one partitioning by
    the group and one sort by group and lane, so that a task holds its lanes once.
    """
    by = list(by)
    rows = df.withColumns({
        "__lane": F.col(lane), "__blank": F.col(identifier).isNull(), "__merges": F.col(permitted),
    })
    keys = [*by, "__lane", "__blank", "__merges"]
    parts = {**into, "__ids": listing(F.col(identifier))}
    cells = merge_partials(partials(rows, keys, parts), keys, parts)
    ids = next(n for n in cells.columns if n.startswith("____ids_e"))
    names = F.sort_array(F.filter(F.transform(F.col(ids), lambda e: e["k"]), lambda k: k.isNotNull()))
    placed = _heads(cells.withColumn("__own", names).drop(ids), by)

    # identifiers of a joining lane must be none, or exactly those of its head (an empty set is the smallest);
    # subgroups are runs of lanes, so the last first lane at or before a lane is its head
    along = Window.partitionBy(*by).orderBy("__lane")
    placed = placed.withColumn("__mine", F.max("__own").over(Window.partitionBy(*by, "__lane")))
    theirs = F.last(F.when(F.col("__lane") == F.col("__head"), F.col("__mine")), ignorenulls=True)
    placed = placed.withColumn("__theirs", theirs.over(along))
    clash = (F.col("__lane") != F.col("__head")) & (F.size("__mine") > 0) & (F.col("__mine") != F.col("__theirs"))
    placed = placed.withColumn("__clash", F.max(clash).over(Window.partitionBy(*by)))
    kept = placed.filter(~F.col("__clash") & ((F.col("__lane") == F.col("__head")) | F.col("__blank")))
    merged = _merged_again(kept, [*by, "merged_lanes"], into)
    merged, ok, out = finish(merged, [*by, "merged_lanes"], into)
    return merged.filter(ok).select(*out)


def _merged_again(parts: DataFrame, keys: Sequence[str], into: Mapping[str, Collector]) -> DataFrame:
    """Merge groups whose keyed entries were gathered already: spread them first, so that equal entries meet."""
    labels = [v for n in into for v in part_labels(into)[n][1]]
    if not labels:
        return merge_partials(parts, keys, into)
    plain = parts.drop(*labels)
    frames = [plain, *[parts.select(*keys, F.explode(label).alias(label)) for label in labels]]
    together = frames[0]
    for f in frames[1:]:
        together = together.unionByName(f, allowMissingColumns=True)
    return merge_partials(together, keys, into)


def _heads(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the first lane of each cell's subgroup, and the subgroup's lanes; unsound groups disappear."""
    whole = Window.partitionBy(*by).orderBy("__lane").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merges, lane, lanes, target = (F.col(n) for n in ("__merges", "__lane", "__lanes", "__target"))
    lanes_of = F.flatten(merges)
    own_set = F.get(F.filter(merges, lambda s: F.array_contains(s, lane)), F.lit(0))
    cells = cells.withColumn("__set", own_set)
    first = F.when(F.size(lanes_of) == F.size(F.array_distinct(lanes_of)), F.array_min("__set"))
    cells = cells.withColumn("__target", first)
    cells = cells.withColumns({
        "__mixed": F.min("__merges").over(whole) != F.max("__merges").over(whole), "__lost": F.max(target.isNull()).over(whole),
    }).filter(~F.col("__mixed") & ~F.col("__lost"))
    # the lanes of a sound group are bounded by the permitted-merges value itself
    cells = cells.withColumn("__lanes", F.sort_array(F.collect_set("__lane").over(whole)))
    gap = F.array_min(F.filter(lanes, lambda x: (x > target) & ~F.array_contains("__set", x)))

    def placed(end: Column) -> Column:
        def before(x: Column) -> Column:
            return end.isNull() | (x < end)

        joins = F.array_contains(lanes, target) & before(lane)
        run = F.filter(lanes, lambda x: (x >= target) & before(x))
        return F.struct(F.when(joins, target).otherwise(lane).alias("head"), F.when(joins, run).otherwise(F.array(lane)).alias("lanes"))

    cells = cells.withColumn("__placed", bind(gap, placed))
    cells = cells.withColumns({"__head": F.col("__placed.head"), "merged_lanes": F.col("__placed.lanes")})
    return cells.drop("__merges", "__set", "__target", "__mixed", "__lost", "__lanes", "__placed")


def barcodes(
    df: DataFrame, by: Sequence[str], mask: str, codes: str, minimum: int, into: Mapping[str, Collector]
) -> DataFrame:
    """Subgroups by ``code_length``, for groups with one mask and no colliding codes.

    ``codes`` is a list of codes (``ACGT``, ``ACGT-TTGA``, ``NoIndex``) per row;
    the mask trims them, and a row joins a subgroup per length of its trimmed
    codes.  Collectors may read ``trimmed_codes`` (those of that length, as a
    set) and ``new_mask`` (the mask cut to them, the smallest if they differ).
    A group with several masks, an unparseable mask or code, a code of which
    the mask leaves nothing, or two codes closer than ``minimum`` (truncated
    Hamming distance; a code listed twice is two codes) is rejected as a whole.
    """
    by = list(by)
    parsed = F.transform(col(codes), lambda c: trim_code(parse_code(c), F.col("__mask")))
    rows = df.withColumn("__mask", parse_mask(mask)).withColumn("__codes", F.coalesce(parsed, F.array().cast("array<struct<one:string,two:string>>")))
    # the rows are read once for the verdict and once for the subgroups; the verdict works on distinct codes
    seen = rows.select(*by, F.col(mask).alias("__text"), F.col("__mask").isNull().alias("__bad"), F.explode_outer("__codes").alias("__code"), (F.size("__codes") > 0).alias("__some"))
    seen = seen.groupBy(*by, "__text", "__bad", "__some", F.col("__code.one").alias("__one"), F.col("__code.two").alias("__two")).agg(F.count(F.lit(1)).alias("__times"))
    seen = cut_lineage(seen)
    unsound = F.bool_or(F.col("__bad") | (F.col("__some") & F.col("__one").isNull()))
    sound = seen.groupBy(*by).agg(F.min("__text").alias("__lo"), F.max("__text").alias("__hi"), unsound.alias("__unsound"))
    sound = sound.filter((F.col("__lo") == F.col("__hi")) & ~F.col("__unsound")).select(*by)
    each = join_same(seen.filter("__some"), sound, by, "left_semi")
    twice = each.filter((F.col("__times") > 1) & F.lit(minimum > 0)).select(*by)
    clash = hamming_collisions(each, by, "__one", minimum, "__two").select(*by).union(twice).distinct()
    good = join_same(sound, clash, by, "left_anti")

    kept = join_same(rows, good, by, "left_semi").withColumn("code_length", F.explode(F.array_distinct(F.transform("__codes", code_length))))
    own = F.filter("__codes", lambda c: code_length(c) == F.col("code_length"))
    kept = kept.withColumns({
        "trimmed_codes": as_set(F.transform(own, write_code)),
        "new_mask": F.array_min(F.transform(own, lambda c: write_mask(narrowed_mask(c, F.col("__mask"))))),
    })
    keys = [*by, "code_length"]
    parts = merge_partials(partials(kept, keys, into), keys, into)
    parts, ok, out = finish(parts, keys, into)
    return parts.filter(ok).select(*out)


def greedy_bins(costs: Column | str, limit: int) -> Column:
    """Split a cost dictionary into buckets of at most ``limit``.

    Items at or over the limit stand alone; the others, dearest first, go to
    the first bucket with room, found in a tree of rooms.  Equal costs are
    taken in name order.
    """
    entries = F.map_entries(col(costs))
    dear = F.filter(entries, lambda e: e["value"] >= limit)
    cheap = F.sort_array(
        F.transform(
            F.filter(entries, lambda e: e["value"] < limit),
            lambda e: F.struct((-e["value"]).cast("bigint").alias("c"), e["key"].alias("k")),
        )
    )
    items = F.transform(cheap, lambda e: F.struct((-e["c"]).alias("cost"), e["k"].alias("name")))
    filled = F.transform(packed(items, limit), lambda names: F.sort_array(names))
    return F.sort_array(F.concat(F.transform(dear, lambda e: F.array(e["key"])), filled))


def grouped_map(df: DataFrame, by: Sequence[str], split: Callable, schema: str) -> DataFrame:
    """A user-written grouper.

    ``split(key, batches)`` receives the key and an iterator of Arrow record
    batches and yields output batches, so a group is streamed, never held.
    """
    return df.groupBy(*by).applyInArrow(split, schema)


def span_length_by_name(df: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Summed interval lengths per name; an interval without numbers counts zero."""
    length = F.abs(F.col(end) - F.col(start))
    return df.groupBy(name).agg(F.sum(F.coalesce(length, F.lit(0))).cast("bigint").alias("length"))
