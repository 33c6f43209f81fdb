"""String functions and small text parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import col, full_match


def trim(text: Column | str) -> Column:
    """Remove control characters and spaces from both ends."""
    return F.regexp_replace(col(text), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def lower(text: Column | str) -> Column:
    return F.lower(col(text))


def upper(text: Column | str) -> Column:
    return F.upper(col(text))


def equal_ignoring_case(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def length(text: Column | str) -> Column:
    return F.length(col(text)).cast("bigint")


def replace(text: Column | str, needle: str | Column, replacement: str | Column) -> Column:
    """Replace literal text."""
    def lit(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.replace(col(text), lit(needle), lit(replacement))


def truncate(text: Column | str, limit: int, method: str, ellipsis: str = "") -> Column:
    """Shorten to a limit, keeping the START, MIDDLE or END as the method names.

    The ``*_ELLIPSIS`` methods put a mark where text was taken out, counted in
    the limit; a mark that fills the limit replaces the text.
    """
    t = col(text)
    size = F.length(t)

    def head(n: int) -> Column:
        return F.substring(t, 1, n) if n > 0 else F.lit("")

    def tail(n: int) -> Column:
        return F.right(t, F.lit(n)) if n > 0 else F.lit("")

    mark, room = F.lit(ellipsis), limit - len(ellipsis)
    half = limit // 2
    front = -((len(ellipsis) - limit) // 2)
    cut = {
        "START": head(limit),
        "MIDDLE": F.concat(head(half), tail(half)),
        "END": tail(limit),
        "START_ELLIPSIS": F.concat(head(room), mark) if room > 0 else mark,
        "MIDDLE_ELLIPSIS": F.concat(head(front), mark, tail(room - front)) if room > 0 else mark,
        "END_ELLIPSIS": F.concat(mark, tail(room)) if room > 0 else mark,
    }[method]
    return F.when(size < limit, t).otherwise(cut)


def hash_code(text: Column | str) -> Column:
    """The 32-bit polynomial hash (base 31) of the UTF-16 text."""

    def step(h: Column, character: Column) -> Column:
        c = F.ascii(character).cast("bigint")
        # a character beyond 16 bits is two units of UTF-16
        lead, trail = F.lit(0xD7C0) + F.floor(c / 1024), F.lit(0xDC00) + c % 1024
        wide = (h * 31 + lead) * 31 + trail
        return F.when(c > 0xFFFF, wide).otherwise(h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))

    characters = F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))
    return F.aggregate(
        characters, F.lit(0).cast("bigint"), step, lambda h: F.when(h >= 2**31, h - F.lit(2**32)).otherwise(h)
    )


def url_decode(text: Column | str) -> Column:
    """Decoded text, or empty if it is not valid."""
    return F.try_url_decode(col(text))


def url_encode(text: Column | str) -> Column:
    return F.replace(F.url_encode(col(text)), F.lit("*"), F.lit("%2A"))


def parse_version(text: Column | str) -> Column:
    """``a.b``, ``a.b.c`` or ``a.b.c.d`` as a tuple of three, else empty."""
    t = col(text)
    pattern = r"\A([0-9]+)\.([0-9]+)(?:\.([0-9]+)(?:\.[0-9]+)?)?\z"

    def part(i: int) -> Column:
        found = F.regexp_extract(t, pattern, i)
        return F.when(found == "", F.lit("0")).otherwise(found).cast("bigint").alias(f"_{i - 1}")

    return F.when(t.rlike(pattern), F.struct(part(1), part(2), part(3)))


def parse_lane(text: Column | str) -> Column:
    """An integer, else the integer after the last underscore, else 0."""
    t = col(text)
    whole = F.when(t.rlike(r"\A\+?[0-9]+\z"), t.try_cast("bigint"))
    suffix = F.regexp_extract(t, r"\A.*_([0-9]+)\z", 1).try_cast("bigint")
    return F.coalesce(whole, suffix, F.lit(0).cast("bigint"))


def first_match(ancestors: Column | str, pattern: str) -> Column:
    """The first ``:``-separated item that matches as a whole, else empty text."""
    items = F.split(col(ancestors), ":")
    return F.coalesce(F.get(F.filter(items, lambda x: full_match(x, pattern)), F.lit(0)), F.lit(""))
