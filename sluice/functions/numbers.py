"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import col


def is_infinite(x: Column | str) -> Column:
    return F.abs(col(x)) == F.lit(float("inf"))


def is_nan(x: Column | str) -> Column:
    return F.isnan(col(x))


def larger(a: Column | str, b: Column | str) -> Column:
    """The larger value; not-a-number wins."""
    return F.greatest(col(a), col(b))


def smaller(a: Column | str, b: Column | str) -> Column:
    return F.least(col(a), col(b))


def smaller_float(a: Column | str, b: Column | str) -> Column:
    """The smaller value; not-a-number wins."""
    nan = F.lit(float("nan"))
    return F.when(F.isnan(col(a)) | F.isnan(col(b)), nan).otherwise(F.least(col(a), col(b)))


def clamp(low: Column, x: Column | str, high: Column) -> Column:
    """The value kept within limits."""
    return F.greatest(low, F.least(col(x), high))


def to_integer(x: Column | str) -> Column:
    """Whole part, toward zero; not-a-number is 0, and what is out of range becomes the nearest bound."""
    x = col(x).cast("double")
    high, low = F.lit(2**63 - 1), F.lit(-(2**63))
    inside = F.when((x < 2.0**63) & (x > -(2.0**63)), x).cast("bigint")
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= 2.0**63, high).when(x <= -(2.0**63), low).otherwise(inside)


def to_float(x: Column | str) -> Column:
    return col(x).cast("double")


def parse_integer(text: Column | str) -> Column:
    """Integer text without spaces, or empty."""
    t = col(text)
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint"))


def parse_float(text: Column | str) -> Column:
    """Decimal text (white space around it allowed), or empty; infinities and not-a-number have their own spelling."""
    t = F.regexp_replace(col(text), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.when(t.rlike(r"\A[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\z"), t.try_cast("double"))


def parse_boolean(text: Column | str) -> Column:
    """True or false in any case, else empty."""
    t = F.lower(col(text))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def version_at_least(version: Column, major: int, minor: int, patch: int) -> Column:
    return version >= _version(major, minor, patch)


def version_less_than(version: Column, major: int, minor: int, patch: int) -> Column:
    return version < _version(major, minor, patch)


def _version(major: int, minor: int, patch: int) -> Column:
    return F.struct(*[F.lit(n).cast("bigint").alias(f"_{i}") for i, n in enumerate((major, minor, patch))])
