"""Running values along a long ordered axis without a global sort.

The axis is cut into buckets of a fixed width.  A window inside each bucket
gives the local part, and each bucket is folded to one row; what earlier
buckets carry in is found the same way, one level up, over the folded rows.
Positions on the axis are distinct, so a bucket never holds more of them than
its width, however the rows are spread, and no task sees more than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.semantics import join_same

SECOND = 1_000_000
# one minute of microseconds, then one day of minutes; the last level has one row per day
TIME_WIDTHS = (60 * SECOND, 1440)


def _running(how: str, window) -> Column:
    return (F.sum("value") if how == "sum" else F.last("value", ignorenulls=True)).over(window)


def _combined(local: str, carry: str, how: str) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.coalesce(local, carry)


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col("at") / F.lit(width)).cast("bigint"))


def _carried(rows: DataFrame, by: Sequence[str], how: str, widths: Sequence[int]) -> DataFrame:
    """What comes before each row: by, at (one row each), carry."""
    if not widths:
        before = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*by, "at", _running(how, before).alias("carry"))
    keys = [*by, "__bucket"]
    inside = Window.partitionBy(*keys).orderBy("at")
    placed = _bucketed(rows, widths[0])
    local = placed.withColumn("__local", _running(how, inside.rowsBetween(Window.unboundedPreceding, -1)))
    up = _folded(placed.withColumn("__local", _running(how, inside.rowsBetween(Window.unboundedPreceding, 0))), keys, "at")
    above = _carried(up, by, how, widths[1:]).withColumnsRenamed({"at": "__bucket", "carry": "__carry"})
    return local.join(above, keys, "left").select(*by, "at", _combined("__local", "__carry", how).alias("carry"))


def _folded(running: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per bucket: its index as ``at``, the running value at its end as ``value``.

    The rows are already partitioned by the bucket, so this needs no exchange.
    """
    last = F.max_by("__local", F.struct(*order))
    return running.groupBy(*keys).agg(last.alias("value")).withColumnRenamed("__bucket", "at")


def running_at(
    probes: DataFrame, steps: DataFrame, by: Sequence[str], how: str, widths: Sequence[int] = TIME_WIDTHS
) -> DataFrame:
    """The running value of ``steps`` at each probe.

    Both frames have the ``by`` columns, ``at`` (bigint) and ``rank`` (order
    among equal ``at``); ``steps`` also has ``value``.  Rows are distinct by
    (by, at, rank).  ``how`` is ``sum`` or ``last``.  Returns by, at, value.
    """
    rows = steps.unionByName(probes.withColumn("__probe", F.lit(True)), allowMissingColumns=True)
    keys = [*by, "__bucket"]
    rows = _bucketed(rows, widths[0]) if widths else rows.withColumn("__bucket", F.lit(0).cast("bigint"))
    inside = (
        Window.partitionBy(*keys).orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.withColumn("__local", _running(how, inside))
    found = running.filter("__probe").select(*keys, "at", "__local")
    if not widths:
        return found.select(*by, "at", _combined("__local", "__local", "last").alias("value"))
    above = _carried(_folded(running, keys, "at", "rank"), by, how, widths[1:])
    above = above.withColumnsRenamed({"at": "__bucket", "carry": "__carry"})
    return found.join(above, keys, "left").select(*by, "at", _combined("__local", "__carry", how).alias("value"))


def positions(df: DataFrame, by: Sequence[str], order: str, name: str, width: int = 100_000) -> DataFrame:
    """0-based position of each row within its group (whose keys may be empty), for a unique integer order.

    Ranks inside buckets of the order plus the row counts of earlier buckets.
    """
    df = df.withColumn("__bucket", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    keys = [*by, "__bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return (
        join_same(df.withColumn("__inside", inside), counts, keys, "left")
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint"))
        .drop("__bucket", "__inside", "__before")
    )
