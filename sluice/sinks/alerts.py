"""Rows to expiring alerts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.exprs import date_plus
from sluice.operators.predicates import Origin
from sluice.semantics import col
from sluice.sinks.actions import location
from sluice.sources.snapshots import read_batches, read_snapshot, update


def _pairs(values: Mapping[str, Column | str]) -> Column:
    """Entries with a value, in name order."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("key"), col(values[n]).cast("string").alias("value")) for n in sorted(values)
    ]).cast("array<struct<key:string,value:string>>")
    return F.filter(entries, lambda e: e["value"].isNotNull())


def alert_id(labels: Column) -> Column:
    """SHA-1 over the sorted label names and values, each closed by a NUL."""
    text = F.array_join(F.transform(labels, lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\0"))), "")
    return F.upper(F.sha1(text.cast("binary")))


def emit_alerts(
    df: DataFrame, labels: Mapping[str, Column | str], annotations: Mapping[str, Column | str],
    ttl_seconds: int | Column, at: Column | str, origin: Origin, instance: str | None = None,
) -> DataFrame:
    """One alert per distinct set of non-empty labels.

    It starts with its first row; the end and the annotations come from its
    last row.  An ``instance`` label is added unless the rows bring their own.
    """
    labels = dict(labels)
    if instance is not None:
        labels.setdefault("instance", F.lit(instance))
    ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    at = col(at)
    ends = date_plus(at, ttl)
    rows = df.select(
        _pairs(labels).alias("labels"), at.alias("__at"),
        F.struct(at.alias("at"), ends.alias("ends_at"), _pairs(annotations).alias("annotations")).alias("__last"),
    )
    merged = rows.groupBy("labels").agg(F.min("__at").alias("starts_at"), F.max("__last").alias("__last"))
    return merged.select(
        alert_id(F.col("labels")).alias("id"), F.map_from_entries("labels").alias("labels"), "starts_at",
        F.col("__last.ends_at").alias("ends_at"), F.map_from_entries("__last.annotations").alias("annotations"),
        F.array(location(origin)).alias("locations"), F.col("__last.at").alias("refreshed_at"),
    )


def alert_refreshes(
    df: DataFrame, labels: Mapping[str, Column | str], ttl_seconds: int | Column, at: Column | str, instance: str | None = None
) -> DataFrame:
    """One row per row: the alert that it refreshes, from when and until when; may be a stream."""
    labels = dict(labels)
    if instance is not None:
        labels.setdefault("instance", F.lit(instance))
    ttl = F.lit(ttl_seconds) if isinstance(ttl_seconds, int) else ttl_seconds
    return df.select(_pairs(labels).alias("pairs"), col(at).alias("at"), date_plus(col(at), ttl).alias("ends_at")).select(
        alert_id(F.col("pairs")).alias("id"), F.map_from_entries("pairs").alias("labels"), "at", "ends_at"
    )


def live_alerts(alerts: DataFrame, now: Column | None = None) -> DataFrame:
    return alerts.filter(F.col("ends_at") > (F.current_timestamp() if now is None else now))


def fold_alerts(rows: DataFrame) -> DataFrame:
    """Several rows per id to one: the first start, end and annotations of the last refresh."""
    return rows.groupBy("id").agg(
        F.any_value("labels").alias("labels"),
        F.min("starts_at").alias("starts_at"),
        # end and annotations of one and the same row, whatever the order of rows with equal times
        F.max(F.struct("refreshed_at", "ends_at", F.sort_array(F.map_entries("annotations")).alias("annotations"))).alias("last"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"),
    ).select(
        "id", "labels", "starts_at", F.col("last.ends_at").alias("ends_at"), F.map_from_entries("last.annotations").alias("annotations"), "locations",
        F.col("last.refreshed_at").alias("refreshed_at"),
    )


def upsert_alerts(path: str, new: DataFrame) -> int:
    """Refresh the alert table at ``path``; repeating the call changes nothing."""
    return update(new.sparkSession, path, lambda old: new if old is None else fold_alerts(old.unionByName(new)))


def alert_scan(spark: SparkSession, path: str) -> DataFrame:
    """The alert table: its snapshot with the batches added since."""
    stored = [d for d in (read_snapshot(spark, path), read_batches(spark, path)) if d is not None]
    if not stored:
        raise FileNotFoundError(path)
    return fold_alerts(stored[0] if len(stored) == 1 else stored[0].unionByName(stored[1]))
