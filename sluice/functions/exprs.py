"""Operators and control flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import as_set, col, full_match, is_true, same

# Integer suffix multipliers.
UNITS = {
    "k": 1000,
    "M": 1000**2,
    "G": 1000**3,
    "ki": 1024,
    "Mi": 1024**2,
    "Gi": 1024**3,
    "mins": 60,
    "hours": 3600,
    "days": 86400,
    "weeks": 604800,
}


def units(n: int, suffix: str) -> int:
    return n * UNITS[suffix]


def if_else(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def switch(reference: Column | str, cases: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """First case equal to the reference."""
    ref = col(reference)
    out = None
    for test, value in cases:
        out = F.when(same(ref, test), value) if out is None else out.when(same(ref, test), value)
    return otherwise if out is None else out.otherwise(otherwise)


def tagged(tag: str, **fields: Column) -> Column:
    """An algebraic value: a tag with the fields of its branch."""
    return F.struct(F.lit(tag).alias("tag"), *[v.alias(n) for n, v in fields.items()])


def match(value: Column | str, branches: Mapping[str, object], otherwise: Column | None = None) -> Column:
    """Choose by tag; a branch is a value, or a function of the tagged value."""
    v = col(value)
    out = None
    for tag, branch in branches.items():
        chosen = branch(v) if callable(branch) and not isinstance(branch, Column) else branch
        test = v["tag"] == tag
        out = F.when(test, chosen) if out is None else out.when(test, chosen)
    return out if otherwise is None else out.otherwise(otherwise)


def match_optional(value: Column | str, some, none: Column) -> Column:
    v = col(value)
    return F.when(v.isNotNull(), some(v)).otherwise(none)


def order(*items: Column) -> Column:
    """The items as a tuple in ascending order."""
    ranked = F.sort_array(F.array(*items))
    return F.struct(*[F.get(ranked, F.lit(i)).alias(f"_{i}") for i in range(len(items))])


def tabulate(**rows: Sequence[Column]) -> Column:
    """Parallel rows as an object of index-to-value dictionaries."""
    return F.struct(*[
        F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(len(values))]), F.array(*values)).alias(n)
        for n, values in rows.items()
    ])


def default(optional: Column | str, value: Column) -> Column:
    return F.coalesce(col(optional), value)


def merge_optionals(*optionals: Column | str) -> Column:
    """The first optional that has a value."""
    return F.coalesce(*[col(o) for o in optionals])


def lift(inputs: Sequence[Column | str], value: Column) -> Column:
    """Empty if any unboxed input is empty."""
    present = None
    for i in inputs:
        present = col(i).isNotNull() if present is None else present & col(i).isNotNull()
    return F.when(present, value)


def set_equal(a: Column | str, b: Column | str) -> Column:
    """Lists are equal as sets."""
    return same(as_set(a), as_set(b))


def dict_equal(a: Column | str, b: Column | str) -> Column:
    return same(F.sort_array(F.map_entries(col(a))), F.sort_array(F.map_entries(col(b))))


def matches(text: Column | str, pattern: str, flags: str = "") -> Column:
    return full_match(text, pattern, flags)


def capture(text: Column | str, pattern: str, groups: int, flags: str = "") -> Column:
    """Whole match as an optional tuple of optional groups.

    Spark reports a group that took no part as an empty string.  A back-reference
    tells it from one that matched the empty string: after the match, which the
    atomic group keeps as it is, it fails only if its group took no part.
    """
    inline = f"(?{flags})" if flags else ""
    anchored = rf"{inline}\A(?:{pattern})\z"
    t = col(text)

    def group(i: int) -> Column:
        found, took_part = F.regexp_extract(t, anchored, i), rf"{inline}\A(?>(?:{pattern})\z)\{i}"
        return F.when((found != "") | t.rlike(took_part), found)

    parts = [group(i + 1).alias(f"_{i}") for i in range(groups)]
    return F.when(t.rlike(anchored), F.struct(*parts))


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", col(a), col(b))


def int_mod(a: Column | str, b: Column | str) -> Column:
    """Remainder with the sign of the dividend."""
    return col(a) % col(b)


def date_plus(ts: Column | str, seconds: Column | int) -> Column:
    """The time some seconds (any 64-bit number of them) later."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(col(ts)) + s.cast("bigint") * 1_000_000)


def date_minus(ts: Column | str, seconds: Column | int) -> Column:
    return date_plus(ts, -(F.lit(seconds) if isinstance(seconds, int) else seconds).cast("bigint"))


def date_diff(a: Column | str, b: Column | str) -> Column:
    """Whole seconds from b to a, rounded down."""
    span = F.unix_micros(col(a)) - F.unix_micros(col(b))
    return int_div(span - F.pmod(span, F.lit(1_000_000)), F.lit(1_000_000))


def pad(number: Column | str, width: int) -> Column:
    """Zero-padded integer text; longer numbers stay whole."""
    s = col(number).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(s), F.lit(0))), s)


def interpolate(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def set_union(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_union(col(a), col(b)))


def set_add(a: Column | str, item: Column) -> Column:
    return F.sort_array(F.array_union(col(a), F.array(item)))


def set_diff(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_except(col(a), col(b)))


def set_remove(a: Column | str, item: Column) -> Column:
    return F.sort_array(F.array_except(col(a), F.array(item)))


def contains(items: Column | str, item: Column) -> Column:
    return is_true(F.array_contains(col(items), item))


def contains_key(entries: Column | str, key: Column) -> Column:
    return F.map_contains_key(col(entries), key)


def concat_tuples(*tuples: tuple[Column, int]) -> Column:
    """Join tuples end to end; each comes with its arity."""
    fields = [t[f"_{i}"] for t, n in tuples for i in range(n)]
    return F.struct(*[f.alias(f"_{i}") for i, f in enumerate(fields)])


def merge_objects(a: Column, a_fields: Sequence[str], b: Column, b_fields: Sequence[str]) -> Column:
    return F.struct(*[a[f].alias(f) for f in a_fields], *[b[f].alias(f) for f in b_fields])


def without(obj: Column, *fields: str) -> Column:
    return obj.dropFields(*fields)


def swizzle(obj: Column, *fields: str) -> Column:
    return F.struct(*[obj[f].alias(f) for f in fields])


def dict_get(entries: Column | str, key: Column) -> Column:
    return F.try_element_at(col(entries), key)


def dictionary(*pairs: tuple[Column, Column], spread: Sequence[Column] = ()) -> Column:
    """Dictionary literal; later entries replace earlier ones."""
    literal = F.create_map(*[x for p in pairs for x in p])
    return F.map_concat(*spread, literal) if spread else literal


def to_pair(value: Column) -> Column:
    """{x, y} as {left, right}."""
    return F.struct(value["_0"].alias("left"), value["_1"].alias("right"))


def from_pair(pair: Column) -> Column:
    """{left, right} as {x, y}."""
    return F.struct(pair["left"].alias("_0"), pair["right"].alias("_1"))


def date_literal(iso: str) -> Column:
    at = datetime.fromisoformat(iso)
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))


def epoch_seconds(n: int | Column) -> Column:
    return F.timestamp_seconds(F.lit(n) if isinstance(n, int) else n)


def epoch_millis(n: int | Column) -> Column:
    return F.timestamp_millis(F.lit(n) if isinstance(n, int) else n)
