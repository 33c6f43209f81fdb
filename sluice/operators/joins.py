"""Joins: equality, overlapping key sets, and left joins with collectors.

Left joins never gather the matches of a left row.  The right side is reduced
to one row per key first; where collectors also read left columns, the matches
are reduced per distinct (key, left columns read).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.clauses import prefixed
from sluice.operators.collectors import Collector
from sluice.operators.grouping import finish, guarded, has_entries, merge_partials, partials
from sluice.semantics import all_of, col

Key = Column | str | Sequence[Column | str]


def _listed(key: Key) -> list[Column]:
    return [col(k) for k in key] if isinstance(key, (list, tuple)) else [col(key)]


def _disjoint(left: DataFrame, right: DataFrame) -> None:
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}; give a prefix")


def _matched(left: Sequence[Column], right: Sequence[Column], optional: bool) -> Column:
    return all_of((a.eqNullSafe(b) if optional else a == b) for a, b in zip(left, right))


def join(
    left: DataFrame, right: DataFrame, left_key: Key, right_key: Key,
    prefix: str | None = None, optional_keys: bool = False,
) -> DataFrame:
    """Inner equality join on key expressions.

    With a prefix the right columns are renamed first, and ``right_key`` names
    the renamed columns.  ``optional_keys`` lets an empty key match an empty key.
    """
    if prefix:
        right = prefixed(right, prefix)
    _disjoint(left, right)
    return left.join(right, _matched(_listed(left_key), _listed(right_key), optional_keys), "inner")


def _exploded(df: DataFrame, keys: Column, tag: str) -> DataFrame:
    """One row per distinct key, carrying the keys that sort before it."""
    sorted_keys = F.array_sort(F.array_distinct(keys))
    at = F.posexplode(F.col(f"__{tag}s")).alias(f"__{tag}i", f"__{tag}k")
    df = df.withColumn(f"__{tag}s", sorted_keys).select("*", at)
    before = F.slice(F.col(f"__{tag}s"), F.lit(1), F.col(f"__{tag}i"))
    return df.withColumn(f"__{tag}s", before).drop(f"__{tag}i")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exploded sides that share a key (empty keys too)."""
    # planned sizes of exploded sides say nothing: never broadcast
    return a.hint("merge").join(b.hint("merge"), F.col("__lk").eqNullSafe(F.col("__rk")), "inner")


def _single_keys(df: DataFrame, ids: Sequence[str], keys: Column, name: str) -> DataFrame:
    return df.select(*ids, F.explode(F.array_distinct(keys)).alias(name))


def intersection_join(
    left: DataFrame, right: DataFrame, left_keys: Column | str, right_keys: Column | str,
    prefix: str | None = None, left_id: Sequence[str] = (), right_id: Sequence[str] = (),
) -> DataFrame:
    """Pair rows whose key sets overlap, each pair once.

    Equality join on single keys; a pair is kept only at its smallest common
    key, so nothing has to be deduplicated afterwards.  Where both sides have
    unique columns (``left_id``, ``right_id``; for wide key sets), only those
    are paired, and the rows are fetched by them.
    """
    if prefix:
        right = prefixed(right, prefix)
    _disjoint(left, right)
    if left_id and right_id:
        a = _single_keys(left, left_id, col(left_keys), "__lk")
        b = _single_keys(right, right_id, col(right_keys), "__rk")
        pairs = _met(a, b).select(*left_id, *right_id).distinct()
        found = pairs.join(left, list(left_id), "inner").join(right, list(right_id), "inner")
        return found.select(*left.columns, *right.columns)
    a = _exploded(left, col(left_keys), "l")
    b = _exploded(right, col(right_keys), "r")
    smallest = ~F.coalesce(F.arrays_overlap("__ls", "__rs"), F.lit(False))
    return _met(a, b).filter(smallest).select(*left.columns, *right.columns)


def membership_join(
    left: DataFrame, right: DataFrame, left_keys: Column | str, right_key: Column | str,
    prefix: str | None = None,
) -> DataFrame:
    """Overlap join with a single key on the right: plain equality after exploding."""
    if prefix:
        right = prefixed(right, prefix)
    _disjoint(left, right)
    a = left.withColumn("__lk", F.explode(F.array_distinct(col(left_keys))))
    return a.join(right, F.col("__lk") == col(right_key), "inner").select(*left.columns, *right.columns)


def _attach(
    left: DataFrame, reduced: DataFrame, names: Sequence[str], plain: Sequence[str],
    into: Mapping[str, Collector], kept: Sequence[str],
) -> DataFrame:
    """Left join reduced matches back, fill empty values, drop rejected rows.

    Names in ``plain`` are never empty and join by ordinary equality.
    """
    renamed = reduced.withColumnsRenamed({n: f"{n}__r" for n in names})
    matched = all_of(_matched([F.col(n)], [F.col(f"{n}__r")], n not in plain) for n in names)
    joined = left.join(renamed, matched, "left")
    parts, ok, out = finish(joined, kept, into)
    if any(k.ok for k in into.values()):
        parts = parts.filter(ok)
    return parts.select(*out)


def _reduced(df: DataFrame, names: Sequence[str], into: Mapping[str, Collector]) -> DataFrame:
    parts = partials(df, names, into)
    return merge_partials(parts, names, into) if has_entries(into) else parts


def left_join(
    left: DataFrame, right: DataFrame, left_key: Key, right_key: Key, into: Mapping[str, Collector],
    where: Column | str | None = None, reads: Sequence[str] = (), prefix: str | None = None,
    optional_keys: bool = False,
) -> DataFrame:
    """Every left row with its matching right rows collected.

    ``reads`` names the left columns that collectors or ``where`` use.  A row
    whose collectors fail (for instance an unmatched ``maximum``) is dropped.
    ``optional_keys`` lets an empty key match an empty key.
    """
    if prefix:
        right = prefixed(right, prefix)
    _disjoint(left, right)
    into = guarded(into, where)
    keys = {f"__k{i}": k for i, k in enumerate(_listed(left_key))}
    names = list(keys)
    keyed_left = left.withColumns(keys)
    keyed_right = right.withColumns(dict(zip(names, _listed(right_key))))
    plain = [] if optional_keys else names
    if not reads:
        return _attach(keyed_left, _reduced(keyed_right, names, into), names, plain, into, left.columns)
    lefts = keyed_left.select(*names, *reads).distinct()
    other = keyed_right.withColumnsRenamed({n: f"{n}__m" for n in names})
    met = _matched([F.col(n) for n in names], [F.col(f"{n}__m") for n in names], optional_keys)
    by = [*names, *reads]
    matches = lefts.join(other, met, "inner")
    return _attach(keyed_left, _reduced(matches, by, into), by, plain, into, left.columns)


def left_intersection_join(
    left: DataFrame, right: DataFrame, left_keys: Column | str, right_keys: Column | str,
    into: Mapping[str, Collector], where: Column | str | None = None, reads: Sequence[str] = (),
    prefix: str | None = None, left_id: Sequence[str] = (), right_id: Sequence[str] = (),
) -> DataFrame:
    """Every left row with the right rows of overlapping key sets collected.

    Matches are reduced per distinct left key set (and left columns read), so
    no row identity is needed, and only distinct sets are paired.  Where both
    sides have unique columns (``left_id``, ``right_id``; for wide key sets),
    matches are reduced per left id instead.
    """
    if prefix:
        right = prefixed(right, prefix)
    _disjoint(left, right)
    into = guarded(into, where)
    if left_id and right_id:
        by = list(left_id)
        slim = left.select(*dict.fromkeys([*by, *reads]), col(left_keys).alias("__set"))
        rows = right.withColumn("__rset", col(right_keys))
        pairs = intersection_join(slim, rows, "__set", "__rset", left_id=by, right_id=right_id)
        return _attach(left, _reduced(pairs, by, into), by, by, into, left.columns)
    keyed = left.withColumn("__set", F.array_sort(F.array_distinct(col(left_keys))))
    by = ["__set", *reads]
    sets = keyed.select(*by).distinct()
    if reads:
        pairs = intersection_join(sets, right, "__set", right_keys)
        return _attach(keyed, _reduced(pairs, by, into), by, ["__set"], into, left.columns)
    # right rows with the same key set are reduced before any pairing
    keyed_right = right.withColumn("__rset", F.array_sort(F.array_distinct(col(right_keys))))
    reduced = partials(keyed_right, ["__rset"], into)
    pairs = intersection_join(sets, reduced, "__set", "__rset")
    return _attach(keyed, merge_partials(pairs, by, into), by, ["__set"], into, left.columns)
