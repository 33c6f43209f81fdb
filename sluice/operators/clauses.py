"""Row clauses: filter, reshape, flatten, guard, extraction rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.collectors import Collector
from sluice.operators.grouping import merge_partials, only_if, part_values, partials, single_item
from sluice.semantics import col, is_true

Handler = Callable[[DataFrame], object]


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Keep rows for which the condition is true."""
    return df.filter(_plain(condition))


def _plain(condition: Column | str) -> Column:
    # a filter already drops unknown, and the bare predicate reaches the scan
    return F.expr(condition) if isinstance(condition, str) else condition


def reject(df: DataFrame, condition: Column, *handlers: Handler) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows); handlers receive the rejected rows."""
    bad = is_true(condition)
    rejected = df.filter(bad)
    for handler in handlers:
        handler(rejected)
    return df.filter(~bad), rejected


def require(df: DataFrame, name: str, optional: Column, *handlers: Handler) -> tuple[DataFrame, DataFrame]:
    """Bind an optional value; rows in which it is empty are rejected."""
    rejected = df.filter(optional.isNull())
    for handler in handlers:
        handler(rejected)
    return df.filter(optional.isNotNull()).withColumn(name, optional), rejected


class Gangs:
    """Named, ordered groups of columns, some left out of the text form when default."""

    def __init__(self, **gangs: Sequence[str | tuple[str, object]]):
        self._gangs = {
            name: [m if isinstance(m, tuple) else (m, None) for m in members]
            for name, members in gangs.items()
        }

    def columns(self, gang: str) -> list[str]:
        return [name for name, _ in self._gangs[gang]]

    def struct(self, gang: str) -> Column:
        return F.struct(*self.columns(gang))

    def text(self, gang: str) -> Column:
        """Values joined with ``_``; a member equal to its stated default is omitted."""
        members = [
            F.col(n).cast("string") if default is None else F.nullif(F.col(n), F.lit(default)).cast("string")
            for n, default in self._gangs[gang]
        ]
        return F.concat_ws("_", *members)


def let(df: DataFrame, *columns: str | Column, **computed: Column) -> DataFrame:
    """A new row shape with exactly these columns."""
    return df.select(*columns, *[e.alias(n) for n, e in computed.items()])


def let_gang(df: DataFrame, gangs: Gangs, gang: str, **computed: Column) -> DataFrame:
    """Copy every column of a gang, plus computed columns."""
    return let(df, *gangs.columns(gang), **computed)


def let_only_if(df: DataFrame, keep: Sequence[str], **optionals: Column) -> DataFrame:
    """Reshape with unwrapped optionals; rows with an empty one are dropped."""
    return only_if(df, **optionals).select(*keep, *optionals)


def let_univalued(df: DataFrame, keep: Sequence[str], **lists: Column) -> DataFrame:
    """Reshape with the single item of each list; other rows are dropped."""
    return single_item(df, **lists).select(*keep, *lists)


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rename columns with a prefix (all of them unless named)."""
    return df.withColumnsRenamed({n: prefix + n for n in (columns or df.columns)})


def flatten(df: DataFrame, name: str, items: Column | str) -> DataFrame:
    """One row per list item; a row with an empty list disappears."""
    return df.withColumn(name, F.explode(col(items)))


def flatten_optional(df: DataFrame, name: str, optional: Column | str) -> DataFrame:
    return only_if(df, **{name: col(optional)})


def flatten_map(df: DataFrame, key: str, value: str, entries: Column | str) -> DataFrame:
    return df.select("*", F.explode(col(entries)).alias(key, value))


def flatten_json(df: DataFrame, name: str, document: Column | str) -> DataFrame:
    """One row per element of a JSON array (as JSON text)."""
    parsed = F.try_parse_json(col(document))
    elements = F.try_variant_get(parsed, "$", "array<variant>")
    return df.withColumn(name, F.explode(elements)).withColumn(name, F.to_json(name))


def check_guard(df: DataFrame, source: DataFrame, check: Collector, require_: Callable[[Column], Column]) -> DataFrame:
    """Run only if a collector over all of ``source`` passes a test."""
    into = {"checked": check}
    parts = merge_partials(partials(source, [], into), [], into)
    values = part_values(into)["checked"]
    verdict = is_true(check.accepts(*values)) & is_true(require_(check.finish(*values)))
    return df.filter(F.coalesce(parts.select(verdict).scalar(), F.lit(False)))


def extract_rules(
    df: DataFrame,
    rules: Sequence[tuple[Column | None, Sequence[str | Column]]],
    prepared: Mapping[str, Sequence[Column]] | None = None,
) -> DataFrame:
    """Each rule filters and projects the same input; results are concatenated.

    A ``$name`` entry in a column list stands for a prepared column list.
    """
    frames = []
    for condition, columns in rules:
        chosen = df if condition is None else df.filter(condition)
        frames.append(chosen.select(*spliced(columns, prepared or {})))
    wanted = frames[0].columns
    for f in frames[1:]:
        if f.columns != wanted:
            raise ValueError(f"every rule must give the same columns: {wanted} and {f.columns}")
    return reduce(DataFrame.unionByName, frames)


def spliced(columns: Sequence[str | Column], prepared: Mapping[str, Sequence[Column]]) -> list[str | Column]:
    out: list[str | Column] = []
    for c in columns:
        if isinstance(c, str) and c.startswith("$"):
            out.extend(prepared[c[1:]])
        else:
            out.append(c)
    return out


def destructure(df: DataFrame, pattern: Mapping[str, str]) -> DataFrame:
    """Bind names to nested fields, e.g. ``{"major": "version._0"}``."""
    return df.withColumns({name: F.col(path) for name, path in pattern.items()})
