"""Conditions over the action and alert tables, as plain columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.semantics import all_of, any_of, is_true

# Column of the action table behind each time condition.
TIMES = {
    "added": "last_added",
    "checked": "last_checked",
    "created": "created",
    "external": "external_timestamp",
    "statuschanged": "last_state_transition",
}


@dataclass(frozen=True)
class Origin:
    """Where a row came from; missing parts match anything."""

    file: str
    line: int | None = None
    column: int | None = None
    hash: str | None = None


def between(kind: str, start: datetime | Column | None = None, end: datetime | Column | None = None) -> Column:
    """Time in [start, end], both ends included; a missing time never matches."""
    at = F.col(TIMES[kind])
    tests = [at.isNotNull()]
    if start is not None:
        tests.append(at >= start)
    if end is not None:
        tests.append(at <= end)
    return all_of(tests)


def ago(kind: str, offset_ms: int, now: Column | None = None) -> Column:
    """Time within the last ``offset_ms``."""
    now = F.current_timestamp() if now is None else now
    return is_true(F.col(TIMES[kind]) >= now - F.make_dt_interval(secs=F.lit(offset_ms / 1000)))


def has_id(ids: Sequence[str]) -> Column:
    return F.col("id").isin(list(ids))


def has_type(types: Sequence[str]) -> Column:
    return F.col("type").isin(list(types))


def has_status(states: Sequence[str]) -> Column:
    return F.col("state").isin(list(states))


def _at_origin(location: Column, origin: Origin) -> Column:
    tests = [location["file"] == origin.file]
    if origin.line is not None:
        tests.append(location["line"] == origin.line)
        if origin.column is not None:
            tests.append(location["column"] == origin.column)
            if origin.hash is not None:
                tests.append(location["hash"] == origin.hash)
    return all_of(tests)


def from_file(files: Sequence[str]) -> Column:
    return F.exists("locations", lambda x: x["file"].isin(list(files)))


def from_origin(origins: Sequence[Origin]) -> Column:
    return F.exists("locations", lambda x: any_of(_at_origin(x, o) for o in origins))


def has_tag(tags: Sequence[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def tag_matches(pattern: str) -> Column:
    """Some tag contains a match of the pattern."""
    return F.exists("tags", lambda t: t.rlike(pattern))


def text(fields: Sequence[str | Column], words: str, match_case: bool = False) -> Column:
    """Literal text in one of the searchable fields."""
    def has(f: str | Column) -> Column:
        f = F.col(f) if isinstance(f, str) else f
        return f.contains(words) if match_case else F.lower(f).contains(words.lower())

    return is_true(any_of(has(f) for f in fields))


def regex(fields: Sequence[str | Column], pattern: str) -> Column:
    return is_true(any_of((F.col(f) if isinstance(f, str) else f).rlike(pattern) for f in fields))


def orphaned(actions: DataFrame, live: DataFrame) -> DataFrame:
    """Actions none of whose origins is in the live set (file, line, column, hash)."""
    origins = actions.select("id", F.explode("locations").alias("o")).select("id", "o.*")
    alive = origins.join(live, ["file", "line", "column", "hash"], "left_semi").select("id").distinct()
    return actions.join(alive, "id", "left_anti")


def both(*conditions: Column) -> Column:
    return all_of(conditions)


def either(*conditions: Column) -> Column:
    return any_of(conditions)


def negated(condition: Column) -> Column:
    return ~is_true(condition)


def all_and(base: Column, named: Mapping[str, Column]) -> Column:
    """The base and any of the named conditions, as one condition."""
    return base & any_of(named.values())


def all_except(base: Column, named: Mapping[str, Column]) -> Column:
    """The base without any of the named conditions."""
    return all_of([base, *[negated(c) for c in named.values()]])


def each_and(base: Column, named: Mapping[str, Column]) -> dict[str, Column]:
    """One condition per name: the base and that condition."""
    return {n: base & c for n, c in named.items()}


# ------------------------------------------------------------------ alerts


def label_present(label: str | None = None, pattern: str | None = None) -> Column:
    """A label of this name, or whose name contains a match of the pattern."""
    if pattern is None:
        return F.map_contains_key("labels", label)
    return F.exists(F.map_keys("labels"), lambda k: k.rlike(pattern))


def label_equals(label: str, value: str | None = None, pattern: str | None = None) -> Column:
    """A label with this value, or whose whole value matches the pattern."""
    found = F.try_element_at("labels", F.lit(label))
    return is_true(found == value if pattern is None else found.rlike(rf"\A(?:{pattern})\z"))


def is_live(now: Column | None = None) -> Column:
    return F.col("ends_at") > (F.current_timestamp() if now is None else now)
