"""List pipelines over array columns: sources, modifiers, samplers, collectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import as_set, bind, col

Fn = Callable[[Column], Column]

# ------------------------------------------------------------------ sources


def from_optional(value: Column | str) -> Column:
    v = col(value)
    return F.when(v.isNull(), F.array()).otherwise(F.array(v))


def from_map(entries: Column | str) -> Column:
    """Dictionary entries as tuples."""
    return F.transform(F.map_entries(col(entries)), lambda e: F.struct(e["key"].alias("_0"), e["value"].alias("_1")))


def from_json(document: Column | str) -> Column:
    """Elements of a JSON array, or values of a JSON object, as JSON text."""
    parsed = F.try_parse_json(col(document))
    elements = F.try_variant_get(parsed, "$", "array<variant>")
    values = F.map_values(F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.coalesce(F.transform(F.coalesce(elements, values), lambda v: F.to_json(v)), F.array())


def json_fields(document: Column | str) -> Column:
    """Fields of a JSON object as {name, value as JSON text}."""
    fields = F.try_variant_get(F.try_parse_json(col(document)), "$", "map<string,variant>")
    return F.coalesce(
        F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("value"))),
        F.array(),
    )


def span(start: Column, end: Column) -> Column:
    """Integers from start up to, not including, end."""
    return F.when(start < end, F.sequence(start.cast("bigint"), (end - 1).cast("bigint"))).otherwise(F.array())


def split(text: Column | str, pattern: str) -> Column:
    """Split by a regular expression; empty pieces at the end are dropped."""

    def trimmed(pieces: Column) -> Column:
        last = F.array_max(F.transform(pieces, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
        return F.when(F.size(pieces) == 1, pieces).otherwise(F.slice(pieces, F.lit(1), last))

    return bind(F.split(col(text), pattern), trimmed)


def zipped(left: Column | str, right: Column | str, left_width: int, right_width: int) -> Column:
    """Match two lists of tuples on their first element, keeping both sides.

    Result: tuples of the key, the left fields and the right fields; a side
    without the key gives empty fields.
    """

    def found(items: Column, key: Column) -> Column:
        return F.get(F.filter(items, lambda t: t["_0"].eqNullSafe(key)), F.lit(0))

    def rows(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]

        def row(key: Column) -> Column:
            fields = [found(a, key)[f"_{i}"] for i in range(1, left_width)]
            fields += [found(b, key)[f"_{i}"] for i in range(1, right_width)]
            return F.struct(key.alias("_0"), *[f.alias(f"_{i + 1}") for i, f in enumerate(fields)])

        keys = F.array_union(F.transform(a, lambda t: t["_0"]), F.transform(b, lambda t: t["_0"]))
        return F.transform(keys, row)

    return bind(F.struct(col(left).alias("a"), col(right).alias("b")), rows)


# ---------------------------------------------------------------- modifiers


def mapped(items: Column | str, fn: Fn) -> Column:
    return F.transform(col(items), fn)


def where(items: Column | str, test: Fn) -> Column:
    return F.filter(col(items), test)


def flat_map(items: Column | str, fn: Fn) -> Column:
    return F.flatten(F.transform(col(items), fn))


def distinct(items: Column | str) -> Column:
    return F.array_distinct(col(items))


def sort(items: Column | str, key: Fn) -> Column:
    """Ascending by key; equal keys keep their order."""
    keyed = F.transform(col(items), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda s: s["x"])


def reverse(items: Column | str) -> Column:
    return F.reverse(col(items))


def limit(items: Column | str, n: int) -> Column:
    return F.slice(col(items), F.lit(1), F.lit(n))


def skip(items: Column | str, n: int) -> Column:
    a = col(items)
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


# ----------------------------------------------------------------- samplers


@dataclass(frozen=True)
class Fixed:
    """The next ``n`` items, optionally only while a condition holds."""

    n: int
    condition: Fn | None = None

    def take(self, items: Column, at: Column) -> tuple[Column, Column]:
        chosen = F.slice(items, at + 1, F.lit(self.n))
        if self.condition is not None:
            stop = F.array_position(F.transform(chosen, self.condition), F.lit(False))
            chosen = F.when(stop > 0, F.slice(chosen, F.lit(1), (stop - 1).cast("int"))).otherwise(chosen)
        return chosen, at + F.size(chosen)


@dataclass(frozen=True)
class Squish:
    """``n`` items evenly spaced over what remains; then moves on by ``n`` items."""

    n: int

    def take(self, items: Column, at: Column) -> tuple[Column, Column]:
        left = F.size(items) - at
        few = left <= self.n
        rest = F.slice(items, at + 1, F.greatest(left, F.lit(0)))
        places = F.sequence(F.lit(0), F.lit(self.n - 1))
        spaced = F.transform(places, lambda i: F.get(items, at + i * F.floor(left / self.n).cast("int")))
        return F.when(few, rest).otherwise(spaced), F.when(few, F.size(items)).otherwise(at + self.n)


def subsample(items: Column | str, *samplers: Fixed | Squish) -> Column:
    """Run samplers one after another over a sorted list."""

    def run(state: Column, rest: Sequence[Fixed | Squish]) -> Column:
        source = state["items"]
        chosen, at = rest[0].take(source, state["at"])
        if len(rest) == 1:
            return F.concat(state["taken"], chosen)
        return bind(
            F.struct(source.alias("items"), at.alias("at"), F.concat(state["taken"], chosen).alias("taken")),
            lambda following: run(following, rest[1:]),
        )

    source = col(items)
    start = F.struct(source.alias("items"), F.lit(0).alias("at"), F.slice(source, F.lit(1), F.lit(0)).alias("taken"))
    return bind(start, lambda state: run(state, samplers))


# --------------------------------------------------------------- collectors


def any_match(items: Column | str, test: Fn) -> Column:
    return F.coalesce(F.exists(col(items), test), F.lit(False))


def all_match(items: Column | str, test: Fn) -> Column:
    return F.coalesce(F.forall(col(items), test), F.lit(False))


def none_match(items: Column | str, test: Fn) -> Column:
    return ~any_match(items, test)


def count(items: Column | str) -> Column:
    return F.size(col(items)).cast("bigint")


def first(items: Column | str) -> Column:
    return F.get(col(items), F.lit(0))


def listing(items: Column | str) -> Column:
    return as_set(items)


def dictionary(items: Column | str, key: Fn, value: Fn) -> Column:
    """Map of the items' keys and values; an item with an empty key is left out, as no key can find it."""
    entries = F.transform(col(items), lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull()))


def maximum(items: Column | str, key: Fn) -> Column:
    """The item with the largest key, or empty."""
    return F.array_max(F.transform(col(items), lambda x: F.struct(key(x).alias("k"), x.alias("x"))))["x"]


def minimum(items: Column | str, key: Fn) -> Column:
    """The item with the smallest key, or empty."""
    return F.array_min(F.transform(col(items), lambda x: F.struct(key(x).alias("k"), x.alias("x"))))["x"]


def lexical_concat(items: Column | str, delimiter: str) -> Column:
    return F.array_join(F.sort_array(col(items)), delimiter)


def fixed_concat(items: Column | str, delimiter: str) -> Column:
    return F.array_join(col(items), delimiter)


def total(items: Column | str, zero: Column | None = None) -> Column:
    """Sum; the zero also sets the type (integer unless given)."""
    start = F.lit(0).cast("bigint") if zero is None else zero
    return F.aggregate(col(items), start, lambda a, x: a + x)


def stats(items: Column | str, kind: str = "double") -> Column:
    """Object of average, count, maximum, minimum and sum (``kind``: item type)."""

    def summary(a: Column) -> Column:
        s = F.aggregate(a, F.lit(0).cast(kind), lambda acc, x: acc + x)
        return F.struct(
            (s / F.nullif(F.size(a), F.lit(0))).cast("double").alias("average"), F.size(a).cast("bigint").alias("count"),
            F.array_max(a).alias("maximum"), F.array_min(a).alias("minimum"), s.alias("sum"),
        )

    return bind(F.transform(col(items), lambda x: x.cast(kind)), summary)


def reduce(items: Column | str, start: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(col(items), start, fn)


def partition_count(items: Column | str, test: Fn) -> Column:
    a = col(items)
    yes = F.size(F.filter(a, test))
    return F.struct(
        yes.cast("bigint").alias("matched_count"), (F.size(a) - yes).cast("bigint").alias("not_matched_count")
    )


def univalued(items: Column | str) -> Column:
    """The single distinct item, or empty."""
    d = F.array_distinct(col(items))
    return F.when(F.size(d) == 1, F.get(d, F.lit(0)))


def as_tuple(items: Column | str, n: int) -> Column:
    """Exactly n items as a tuple, or empty."""
    a = col(items)
    return F.when(F.size(a) == n, F.struct(*[F.get(a, F.lit(i)).alias(f"_{i}") for i in range(n)]))


def obj(items: Column | str, **collectors: Callable[[Column], Column]) -> Column:
    """Several collectors over one list."""
    return bind(col(items), lambda a: F.struct(*[c(a).alias(n) for n, c in collectors.items()]))


def present(items: Column | str) -> Column:
    """Only the items that have a value."""
    return F.filter(col(items), lambda x: x.isNotNull())


@dataclass(frozen=True)
class TableStyle:
    data_start: str
    data_separator: str
    data_end: str
    header_start: str
    header_separator: str
    header_end: str
    header_underline: str | None = None


# Delimiters of ready-made table styles.
HTML = TableStyle("<tr><td>", "</td><td>", "</td></tr>", "<tr><th>", "</th><th>", "</th></tr>")
MARKDOWN = TableStyle("|", "|", "|", "|", "|", "|", "|---")
WIKI = TableStyle("|", "|", "|", "||", "||", "||")


def table(items: Column | str, columns: Mapping[str, Fn], style: TableStyle) -> Column:
    """A text table: header, optional underline, one line per item; an empty cell stays a cell."""
    names: Sequence[str] = list(columns)
    header = style.header_start + style.header_separator.join(names) + style.header_end + "\n"
    if style.header_underline is not None:
        header += style.header_underline * len(names) + "\n"
    lines = F.transform(
        col(items),
        lambda x: F.concat(
            F.lit(style.data_start),
            F.concat_ws(style.data_separator, *[F.coalesce(fn(x).cast("string"), F.lit("")) for fn in columns.values()]),
            F.lit(style.data_end),
        ),
    )
    return F.concat(F.lit(header), F.array_join(lines, "\n"))
