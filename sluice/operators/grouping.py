"""Group-by with collectors, reject streams, key forms and picking rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import collectors as c
from sluice.operators.collectors import Collector
from sluice.semantics import all_of, col, is_true

Keys = Sequence[str] | Mapping[str, Column]


def key_columns(keys: Keys) -> list[Column]:
    """Grouping keys given as names or as ``{name: expression}``."""
    if isinstance(keys, Mapping):
        return [e.alias(n) for n, e in keys.items()]
    return [F.col(k) for k in keys]


def part_labels(into: Mapping[str, Collector]) -> dict[str, tuple[list[str], list[str]]]:
    return {
        name: (
            [f"__{name}_p{i}" for i in range(len(k.parts))],
            [f"__{name}_e{i}" for i in range(len(k.entries))],
        )
        for name, k in into.items()
    }


def partials(df: DataFrame, keys: Keys, into: Mapping[str, Collector]) -> DataFrame:
    """Partial results: keys plus part columns, possibly several rows per group.

    Plain parts give one row per group.  Keyed entries give one row per
    (group, entry key), reduced before the group is put together; both come
    from one read of the rows and one exchange.
    """
    by = key_columns(keys)
    names = list(keys)
    labels = part_labels(into)
    keyed = [(e, label) for name, k in into.items() for e, label in zip(k.entries, labels[name][1])]

    def plain(condition: Column | None) -> list[Column]:
        return [p.rows(condition).alias(label) for name, k in into.items() for p, label in zip(k.parts, labels[name][0])]

    if not keyed:
        return df.groupBy(*by).agg(*plain(None)) if plain(None) else df.select(*by).distinct()
    cells = [F.col(label).alias(label) for name in into for label in labels[name][0]]
    if len(keyed) == 1 and (keyed[0][0].one or not cells):
        # plain parts are merged later, so they may be reduced by (group, entry key) along with the entries
        (e, label), rows = keyed[0], df
        if e.one:
            has, k, v = e.one(None)
        else:
            rows = df.select("*", F.explode_outer(e.items(None)).alias("__x"))
            has, k, v = F.col("__x").isNotNull(), F.col("__x.k"), F.col("__x.v")
        reduced = rows.groupBy(*by, has.alias("__has"), F.when(has, k).alias("__ek")).agg(*plain(None), e.resolve(F.when(has, v)).alias("__ev"))
        return reduced.select(*names, *cells, F.when(F.col("__has"), F.struct(F.col("__ek").alias("k"), F.col("__ev").alias("v"))).alias(label))
    # one pass: a row gives its entries, and itself (tag -1) for plain parts or if it has none; they are reduced by (group, tag, entry key)
    items = [e.items(None) for e, _ in keyed]
    kinds = [df.select(i.alias("x")).schema["x"].dataType.elementType.simpleString() for i in items]

    def tagged(tag: int, entry: Column | None) -> Column:
        places = [entry if i == tag else F.lit(None).cast(kind) for i, kind in enumerate(kinds)]
        return F.struct(F.lit(tag).alias("tag"), *[p.cast(kind).alias(f"e{i}") for i, (p, kind) in enumerate(zip(places, kinds))])

    own = F.array(tagged(-1, None))

    def listed(tag: int) -> Column:
        return F.coalesce(F.transform(items[tag], lambda x: tagged(tag, x)), F.slice(own, 1, 0))

    entries = F.concat(*[listed(i) for i in range(len(items))])
    exploded = df.withColumn("__e", F.explode(F.concat(own, entries) if cells else F.when(F.size(entries) > 0, entries).otherwise(own)))
    tag = F.col("__e.tag")
    reduced = exploded.groupBy(*by, tag.alias("__tag"), *[F.col(f"__e.e{i}.k").alias(f"__ek{i}") for i in range(len(keyed))]).agg(
        *plain(tag == -1), *[e.resolve(F.col(f"__e.e{i}.v")).alias(f"__ev{i}") for i, (e, _) in enumerate(keyed)]
    )
    return reduced.select(
        *names,
        *[F.when(F.col("__tag") == -1, F.col(label)).alias(label) for name in into for label in labels[name][0]],
        *[F.when(F.col("__tag") == i, F.struct(F.col(f"__ek{i}").alias("k"), F.col(f"__ev{i}").alias("v"))).alias(label) for i, (_, label) in enumerate(keyed)],
    )


def merge_partials(parts: DataFrame, keys: Sequence[str], into: Mapping[str, Collector]) -> DataFrame:
    """One row per group from partial results."""
    labels = part_labels(into)
    merged = []
    for name, k in into.items():
        merged += [p.merge(F.col(label)).alias(label) for p, label in zip(k.parts, labels[name][0])]
        merged += [F.collect_list(F.col(label)).alias(label) for label in labels[name][1]]
    return parts.groupBy(*keys).agg(*merged)


def part_values(into: Mapping[str, Collector]) -> dict[str, list[Column]]:
    return {n: [F.col(x) for x in (*ps, *es)] for n, (ps, es) in part_labels(into).items()}


def has_entries(into: Mapping[str, Collector]) -> bool:
    return any(k.entries for k in into.values())


def finish(parts: DataFrame, kept: Sequence[str], into: Mapping[str, Collector]) -> tuple[DataFrame, Column, list[Column]]:
    """The finished columns and the acceptance condition over part columns."""
    values = part_values(into)
    ok = all_of(k.accepts(*values[n]) for n, k in into.items() if k.ok)
    out = [F.col(x) for x in kept] + [k.finish(*values[n]).alias(n) for n, k in into.items()]
    return parts, ok, out


def guarded(into: Mapping[str, Collector], where: Column | str | None) -> dict[str, Collector]:
    if where is None:
        return dict(into)
    return {n: c.where(where, k) for n, k in into.items()}


def _grouped(df: DataFrame, keys: Keys, into: Mapping[str, Collector], where) -> tuple[DataFrame, Column, list[Column]]:
    into = guarded(into, where)
    parts = partials(df, keys, into)
    if has_entries(into):
        parts = merge_partials(parts, list(keys), into)
    return finish(parts, list(keys), into)


def group_by(
    df: DataFrame, keys: Keys, into: Mapping[str, Collector], where: Column | str | None = None
) -> DataFrame:
    """Group rows and collect; rejected groups are left out.

    ``where`` narrows what the collectors see; a group with no matching row
    stays.
    """
    parts, ok, out = _grouped(df, keys, into, where)
    if any(k.ok for k in into.values()):
        parts = parts.filter(ok)
    return parts.select(*out)


def group_by_with_rejects(
    df: DataFrame, keys: Keys, into: Mapping[str, Collector], where: Column | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted groups, keys of the rejected groups)."""
    parts, ok, out = _grouped(df, keys, into, where)
    good = is_true(ok)
    return parts.filter(good).select(*out), parts.filter(~good).select(*list(keys))


def only_if(df: DataFrame, **optionals: Column) -> DataFrame:
    """Unwrap optional columns, dropping rows in which one is empty."""
    df = df.withColumns(optionals)
    return df.filter(all_of(F.col(n).isNotNull() for n in optionals))


def single_item(df: DataFrame, **lists: Column) -> DataFrame:
    """Unwrap list columns, keeping rows whose list has exactly one distinct item."""
    sets = {n: F.array_distinct(e) for n, e in lists.items()}
    df = df.withColumns(sets)
    df = df.filter(all_of(F.size(n) == 1 for n in lists))
    return df.withColumns({n: F.get(n, F.lit(0)) for n in lists})


def _pick(df: DataFrame, by: Keys, choose: Column, ties: Sequence[Column | str], largest: bool) -> DataFrame:
    """One whole row per key through a partial aggregate: no group is gathered."""
    rank = F.struct(choose.alias("_0"), *[col(t).alias(f"_{i + 1}") for i, t in enumerate(ties)])
    row = F.struct(*[F.col(x) for x in df.columns])
    picked = F.max_by(row, rank) if largest else F.min_by(row, rank)
    by_columns = [e.alias(f"__by{i}") for i, e in enumerate(_key_expressions(by))]
    return df.groupBy(*by_columns).agg(picked.alias("__row")).select("__row.*")


def _key_expressions(keys: Keys) -> list[Column]:
    return list(keys.values()) if isinstance(keys, Mapping) else [F.col(k) for k in keys]


def pick_max(df: DataFrame, choose: Column | str, by: Keys, ties: Sequence[Column | str] = ()) -> DataFrame:
    """Keep the row with the largest value per key; ``ties`` make it repeatable."""
    return _pick(df, by, col(choose), ties, True)


def pick_min(df: DataFrame, choose: Column | str, by: Keys, ties: Sequence[Column | str] = ()) -> DataFrame:
    """Keep the row with the smallest value per key; ``ties`` make it repeatable."""
    return _pick(df, by, col(choose), ties, False)
