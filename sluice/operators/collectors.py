"""Collectors: what a group is turned into.

A collector is made of mergeable *parts* (ordinary Spark aggregates with a
merge step), a ``finish`` expression over the parts and an optional ``ok``
condition that rejects the group.  ``finish`` over missing parts gives the
value of an empty group, so the same collector serves grouping, left joins
and guards, and pre-aggregated partial results can be merged later.

Collectors whose result is keyed (dictionaries, flattened lists) use
``entries``: rows are first reduced to one row per (group, entry key), so that
a hot group is spread over its entries before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import all_of, as_set, col, is_true


@dataclass(frozen=True)
class Part:
    """One aggregate: ``rows(condition)`` over rows, ``merge(column)`` over parts."""

    rows: Callable[[Column | None], Column]
    merge: Callable[[Column], Column]


@dataclass(frozen=True)
class Entries:
    """Keyed entries of a row: ``items`` is an array of struct<k, v>.

    Where a row has one entry at most, ``one`` gives (is there one, k, v).
    """

    items: Callable[[Column | None], Column]
    resolve: Callable[[Column], Column]
    one: Callable[[Column | None], tuple[Column, Column, Column]] | None = None


def _single(key: Column, value: Column, resolve: Callable[[Column], Column], needed: Column | None = None) -> Entries:
    """Entries of rows that have one each, or none where ``needed`` does not hold."""

    def items(c: Column | None) -> Column:
        return _given(_both(c, needed), F.array(F.struct(key.alias("k"), value.alias("v"))))

    def one(c: Column | None) -> tuple[Column, Column, Column]:
        both = _both(c, needed)
        return F.lit(True) if both is None else is_true(both), key, value

    return Entries(items, resolve, one)


@dataclass(frozen=True)
class Collector:
    parts: tuple[Part, ...]
    finish: Callable[..., Column]
    ok: Callable[..., Column] | None = None
    entries: tuple[Entries, ...] = field(default=())

    def width(self) -> int:
        return len(self.parts) + len(self.entries)

    def accepts(self, *values: Column) -> Column:
        return self.ok(*values) if self.ok else F.lit(True)


def _given(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def _both(a: Column | None, b: Column | None) -> Column | None:
    if a is None:
        return b
    return a if b is None else a & b


def _sum_part(value: Column) -> Part:
    return Part(lambda c: F.sum(_given(c, value)), F.sum)


def _count_part(condition: Column | None = None) -> Part:
    def rows(c: Column | None) -> Column:
        both = _both(c, condition)
        return F.count(F.lit(1)) if both is None else F.count(F.when(both, F.lit(1)))

    return Part(rows, F.sum)


def _extreme(value: Column, fn: Callable[[Column], Column]) -> Part:
    return Part(lambda c: fn(_given(c, value)), fn)


def _zero(n: Column) -> Column:
    return F.coalesce(n, F.lit(0))


# ---------------------------------------------------------------- counting


def count() -> Collector:
    """Number of rows."""
    return Collector((_count_part(),), _zero)


def any_match(condition: Column | str) -> Collector:
    """True if some row matches; an empty group gives false."""
    return Collector((_extreme(is_true(condition), F.bool_or),), lambda p: F.coalesce(p, F.lit(False)))


def all_match(condition: Column | str) -> Collector:
    """True if every row matches; an empty group gives true."""
    return Collector((_extreme(is_true(condition), F.bool_and),), lambda p: F.coalesce(p, F.lit(True)))


def none_match(condition: Column | str) -> Collector:
    """True if no row matches; an empty group gives true."""
    return Collector((_extreme(is_true(condition), F.bool_or),), lambda p: ~F.coalesce(p, F.lit(False)))


def partition_count(condition: Column | str) -> Collector:
    """Object of matched_count and not_matched_count."""
    c = is_true(condition)
    return Collector(
        (_count_part(c), _count_part(~c)),
        lambda yes, no: F.struct(_zero(yes).alias("matched_count"), _zero(no).alias("not_matched_count")),
    )


# ---------------------------------------------------------------- numbers


def total(value: Column | str) -> Collector:
    """Sum; an empty group gives zero."""
    return Collector((_sum_part(col(value)),), _zero)


def stats(value: Column | str) -> Collector:
    """Object of average, count, maximum, minimum and sum."""
    v = col(value)
    return Collector(
        (_sum_part(v), _count_part(v.isNotNull()), _extreme(v, F.min), _extreme(v, F.max)),
        lambda s, n, lo, hi: F.struct(
            (s / F.nullif(n, F.lit(0))).alias("average"),
            _zero(n).alias("count"),
            hi.alias("maximum"),
            lo.alias("minimum"),
            _zero(s).alias("sum"),
        ),
    )


# ---------------------------------------------------------------- optima


def maximum(value: Column | str, default: Column | None = None) -> Collector:
    """Largest value.  Empty rejects the group; a default joins the contest."""
    part = _extreme(col(value), F.max)
    if default is None:
        return Collector((part,), lambda p: p, lambda p: p.isNotNull())
    return Collector((part,), lambda p: F.greatest(p, default))


def minimum(value: Column | str, default: Column | None = None) -> Collector:
    """Smallest value.  Empty rejects the group; a default joins the contest."""
    part = _extreme(col(value), F.min)
    if default is None:
        return Collector((part,), lambda p: p, lambda p: p.isNotNull())
    return Collector((part,), lambda p: F.least(p, default))


def first(value: Column | str, default: Column | None = None, order: Column | None = None) -> Collector:
    """Some value of the group, made repeatable: the smallest, or the first by ``order``."""
    v = col(value)
    if order is None:
        part, read = _extreme(v, F.min), lambda p: p
    else:
        pair = F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v")))
        part, read = _extreme(pair, F.min), lambda p: p["v"]
    if default is None:
        return Collector((part,), read, lambda p: p.isNotNull())
    return Collector((part,), lambda p: F.coalesce(read(p), default))


def univalued(value: Column | str, default: Column | None = None) -> Collector:
    """The only distinct value; none or several reject the group (or give the default).

    An empty optional is a value that is not another; ``drop_empty`` skips it.
    """
    v = col(value)
    parts = (_extreme(v, F.min), _extreme(v, F.max), _extreme(v.isNull(), F.bool_or))

    def single(lo: Column, hi: Column, gap: Column) -> Column:
        return lo.isNotNull() & (lo == hi) & ~gap

    if default is None:
        return Collector(parts, lambda lo, hi, gap: lo, lambda *seen: is_true(single(*seen)))
    return Collector(parts, lambda lo, hi, gap: F.when(single(lo, hi, gap), lo).otherwise(default))


# ---------------------------------------------------------------- lists


def _distinct(value: Column) -> Entries:
    """Every value once per group, reduced by (group, value) before anything is gathered."""
    return _single(value, F.lit(None).cast("boolean"), F.max)


def _given_values(e: Column) -> Column:
    """The set of values (merged parts may have one twice)."""
    return as_set(F.filter(F.transform(e, lambda s: s["k"]), lambda k: k.isNotNull()))


def listing(value: Column | str, keep_empty: bool = False) -> Collector:
    """Sorted distinct list; ``keep_empty`` lets one empty optional through."""
    read = (lambda e: as_set(F.transform(e, lambda s: s["k"]))) if keep_empty else _given_values
    return Collector((), lambda e: F.coalesce(read(e), F.array()), entries=(_distinct(col(value)),))


def lexical_concat(value: Column | str, delimiter: str) -> Collector:
    """Distinct strings in ascending order, joined."""
    return Collector((), lambda e: F.coalesce(F.array_join(_given_values(e), delimiter), F.lit("")), entries=(_distinct(col(value)),))


def flattened(items: Column | str) -> Collector:
    """Union of list values."""
    v = col(items)

    def pairs(c: Column | None) -> Column:
        source = F.transform(v, lambda x: F.struct(x.alias("k"), F.lit(None).cast("boolean").alias("v")))
        return _given(c, source)

    return Collector(
        (),
        lambda e: F.coalesce(as_set(F.transform(e, lambda s: s["k"])), F.array()),
        entries=(Entries(pairs, F.max),),
    )


def dictionary(key: Column | str, value: Column | str) -> Collector:
    """Map of key to value; a repeated key keeps its smallest value, and rows with an empty key are left out."""
    k, v = col(key), col(value)
    return Collector(
        (),
        lambda e: F.map_from_entries(
            # merged parts may have a key twice: the last entry wins, so the smallest value stands last
            F.coalesce(F.sort_array(F.transform(e, lambda s: F.struct(s["k"].alias("k"), s["v"].alias("v"))), False), F.array())
        ),
        entries=(_single(k, v, F.min, k.isNotNull()),),
    )


# ---------------------------------------------------------------- modifiers


def where(condition: Column | str, inner: Collector) -> Collector:
    """Let the inner collector see only matching rows; the group itself stays."""
    keep = is_true(condition)

    def narrowed(p: Part) -> Part:
        return Part(lambda c: p.rows(_both(c, keep)), p.merge)

    def narrowed_entries(e: Entries) -> Entries:
        return Entries(lambda c: e.items(_both(c, keep)), e.resolve, (lambda c: e.one(_both(c, keep))) if e.one else None)

    return replace(
        inner,
        parts=tuple(narrowed(p) for p in inner.parts),
        entries=tuple(narrowed_entries(e) for e in inner.entries),
    )


def obj(**members: Collector) -> Collector:
    """Struct of several collectors over the same rows."""
    names = list(members)
    parts = tuple(p for m in members.values() for p in m.parts)
    entries = tuple(e for m in members.values() for e in m.entries)

    def split(values: tuple[Column, ...]) -> list[tuple[Column, ...]]:
        plain, keyed = list(values[: len(parts)]), list(values[len(parts) :])
        shares = []
        for m in members.values():
            shares.append(tuple(plain[: len(m.parts)]) + tuple(keyed[: len(m.entries)]))
            plain, keyed = plain[len(m.parts) :], keyed[len(m.entries) :]
        return shares

    def finish(*values: Column) -> Column:
        shares = split(values)
        return F.struct(*[members[n].finish(*s).alias(n) for n, s in zip(names, shares)])

    def ok(*values: Column) -> Column:
        return all_of(m.accepts(*s) for m, s in zip(members.values(), split(values)))

    return Collector(parts, finish, ok if any(m.ok for m in members.values()) else None, entries)


def _over_optional(inputs, inner: Collector, counted: Part, finish, ok) -> Collector:
    present = all_of(col(i).isNotNull() for i in inputs)
    narrowed = where(present, inner)

    def rest(values: tuple[Column, ...]) -> tuple[Column, ...]:
        return values[1:]

    return Collector(
        (counted, *narrowed.parts),
        lambda *v: finish(_zero(v[0]), inner.finish(*rest(v)), inner.accepts(*rest(v))),
        (lambda *v: ok(_zero(v[0]), inner.accepts(*rest(v)))) if ok else None,
        narrowed.entries,
    )


def _empties(inputs) -> Part:
    return _count_part(~all_of(col(i).isNotNull() for i in inputs))


def _presents(inputs) -> Part:
    return _count_part(all_of(col(i).isNotNull() for i in inputs))


def drop_empty(inputs: list, inner: Collector) -> Collector:
    """Skip rows in which an optional input is empty."""
    return where(all_of(col(i).isNotNull() for i in inputs), inner)


def only_if_all(inputs: list, inner: Collector) -> Collector:
    """Optional result: empty if any input is empty."""
    return _over_optional(inputs, inner, _empties(inputs), lambda n, v, good: F.when((n == 0) & good, v), None)


def only_if_any(inputs: list, inner: Collector) -> Collector:
    """Optional result: empty if no input is present."""
    return _over_optional(inputs, inner, _presents(inputs), lambda n, v, good: F.when((n > 0) & good, v), None)


def require_all(inputs: list, inner: Collector) -> Collector:
    """Reject the group if any input is empty."""
    return _over_optional(inputs, inner, _empties(inputs), lambda n, v, good: v, lambda n, good: (n == 0) & good)


def require_any(inputs: list, inner: Collector) -> Collector:
    """Reject the group if no input is present."""
    return _over_optional(inputs, inner, _presents(inputs), lambda n, v, good: v, lambda n, good: (n > 0) & good)
