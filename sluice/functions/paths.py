"""Path functions over text paths, compared name by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import bind, col


def to_path(text: Column | str) -> Column:
    """Collapse repeated slashes and drop a trailing one."""
    collapsed = F.regexp_replace(col(text), "/+", "/")
    return F.when(collapsed == "/", collapsed).otherwise(F.regexp_replace(collapsed, r"/\z", ""))


def names(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def _absolute(path: Column) -> Column:
    return path.startswith("/")


def _build(absolute: Column, segments: Column) -> Column:
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(segments, "/"))


def file(path: Column | str) -> Column:
    """Last name, or empty for the root."""
    return F.get(F.reverse(names(path)), F.lit(0))


def directory(path: Column | str) -> Column:
    """All but the last name, or empty if there is none."""

    def parent(p: Column) -> Column:
        found = names(p)
        above = _build(_absolute(p), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
        return F.when((F.size(found) > 1) | (_absolute(p) & (F.size(found) == 1)), above)

    return bind(to_path(path), parent)


def normalize(path: Column | str) -> Column:
    """Remove ``.`` and resolve ``..`` where a name precedes it."""
    p = col(path)
    absolute = _absolute(p)

    def step(kept: Column, name: Column) -> Column:
        last = F.get(F.reverse(kept), F.lit(0))
        poppable = (F.size(kept) > 0) & (last != "..")
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        up = F.when(poppable, popped).when(absolute, kept).otherwise(F.array_append(kept, name))
        return F.when(name == ".", kept).when(name == "..", up).otherwise(F.array_append(kept, name))

    kept = F.aggregate(names(p), F.array().cast("array<string>"), step)
    return _build(absolute, kept)


def resolve(base: Column | str, other: Column | str) -> Column:
    """Append a path; an absolute right side wins."""
    b, o = col(base), col(other)
    return (
        F.when(_absolute(o) | (b == ""), o).when(o == "", b).when(b.endswith("/"), F.concat(b, o))
        .otherwise(F.concat_ws("/", b, o))
    )


def relativize(directory_: Column | str, path: Column | str) -> Column:
    """The way from a directory to a path."""

    def common(both: Column) -> Column:
        """Number of leading names in both."""
        paired = F.zip_with(both["a"], both["b"], lambda x, y: x.eqNullSafe(y) & x.isNotNull())
        differs = F.array_position(paired, F.lit(False))
        return F.struct(
            both["a"].alias("a"), both["b"].alias("b"),
            F.when(differs > 0, differs - 1).otherwise(F.size(paired)).cast("int").alias("shared"),
        )

    def way(p: Column) -> Column:
        ups = F.array_repeat(F.lit(".."), F.size(p["a"]) - p["shared"])
        downs = F.slice(p["b"], p["shared"] + 1, F.size(p["b"]) - p["shared"])
        return F.array_join(F.concat(ups, downs), "/")

    both = F.struct(names(directory_).alias("a"), names(path).alias("b"))
    return bind(bind(both, common), way)


def replace_home(path: Column | str, home: Column) -> Column:
    """Replace a leading ``~`` or ``$HOME`` name."""
    p = col(path)
    found = names(p)
    rest = F.array_join(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), "/")
    return F.when(F.get(found, F.lit(0)).isin("~", "$HOME"), resolve(home, rest)).otherwise(p)


def starts_with(path: Column | str, prefix: Column) -> Column:
    a, b = names(path), names(prefix)
    return (_absolute(col(path)) == _absolute(prefix)) & (F.slice(a, F.lit(1), F.size(b)) == b)


def ends_with(path: Column | str, suffix: Column) -> Column:
    a, b = names(path), names(suffix)
    tail = F.slice(a, F.greatest(F.size(a) - F.size(b), F.lit(0)) + 1, F.size(b))
    return F.when(_absolute(suffix), col(path) == suffix).otherwise((F.size(a) >= F.size(b)) & (tail == b))


def change_prefix(path: Column | str, prefixes: Mapping[str, str]) -> Column:
    """Replace the longest listed prefix (by number of names)."""
    p = col(path)
    out = p
    for old, new in sorted(prefixes.items(), key=lambda e: len([s for s in e[0].split("/") if s])):
        depth = len([s for s in old.split("/") if s])
        if depth:
            found = names(p)
            rest = F.array_join(F.slice(found, F.lit(depth + 1), F.greatest(F.size(found) - depth, F.lit(0))), "/")
            out = F.when(starts_with(p, F.lit(old)), resolve(F.lit(new), rest)).otherwise(out)
    return out
