"""Date functions.  ``utc_*`` read the instant in UTC, ``local_*`` in a given zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.semantics import col


def _at(ts: Column | str, zone: str | None) -> Column:
    return col(ts) if zone is None else F.from_utc_timestamp(col(ts), zone)


def to_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts))


def to_millis(ts: Column | str) -> Column:
    return F.unix_millis(col(ts))


def from_seconds(n: Column | str) -> Column:
    return F.timestamp_seconds(col(n))


def from_millis(n: Column | str) -> Column:
    return F.timestamp_millis(col(n))


def year(ts: Column | str, zone: str | None = None) -> Column:
    return F.year(_at(ts, zone)).cast("bigint")


def day_of_year(ts: Column | str, zone: str | None = None) -> Column:
    return F.dayofyear(_at(ts, zone)).cast("bigint")


def day_of_month(ts: Column | str, zone: str | None = None) -> Column:
    return F.dayofmonth(_at(ts, zone)).cast("bigint")


def hour_of_day(ts: Column | str, zone: str | None = None) -> Column:
    return F.hour(_at(ts, zone)).cast("bigint")


def minute_of_hour(ts: Column | str, zone: str | None = None) -> Column:
    return F.minute(_at(ts, zone)).cast("bigint")


def second_of_minute(ts: Column | str, zone: str | None = None) -> Column:
    return F.second(_at(ts, zone)).cast("bigint")


def month(ts: Column | str, zone: str | None = None) -> Column:
    """Tag such as JANUARY."""
    return F.upper(F.date_format(_at(ts, zone), "MMMM"))


def day_of_week(ts: Column | str, zone: str | None = None) -> Column:
    """Tag such as MONDAY."""
    return F.upper(F.date_format(_at(ts, zone), "EEEE"))


def date(y: Column, m: Column, d: Column, zone: str = "UTC") -> Column:
    """Midnight of a calendar date, or empty if there is no such date."""
    zero = F.lit(0)
    return date_time(y, m, d, zero, zero, zero, zero, zone)


def date_time(
    y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, nanos: Column, zone: str = "UTC"
) -> Column:
    """An instant, or empty if it does not exist; nanoseconds are cut to microseconds."""
    micros = F.floor(nanos / F.lit(1000))
    seconds = s.cast("decimal(16,6)") + (micros.cast("decimal(16,6)") / F.lit(1_000_000)).cast("decimal(16,6)")
    valid = s.between(0, 59) & nanos.between(0, 999_999_999)
    made = F.try_make_timestamp(
        y.cast("int"), mo.cast("int"), d.cast("int"), h.cast("int"), mi.cast("int"),
        seconds.cast("decimal(16,6)"), F.lit(zone),
    )
    return F.when(valid, made)


def start_of_day(ts: Column | str) -> Column:
    """Midnight UTC."""
    return F.date_trunc("day", col(ts))


def epoch() -> Column:
    return F.timestamp_seconds(F.lit(0))


def now() -> Column:
    """The current time, one value per query."""
    return F.current_timestamp()
