"""Replace the content of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.semantics import col
from sluice.sources.snapshots import publish, read_snapshot, when_written


def refill_table(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Make these rows the content of a store; read it with ``read_snapshot``.

    The rows may come from the store itself, and readers see the old content
    until the new one is whole.
    """
    return publish(df, path, fmt=fmt)


def content_mark(df: DataFrame) -> DataFrame:
    """One row that depends only on the set of distinct rows.

    Rows are hashed where they are, equal hashes dropped, and the hashes
    folded by operations in which order does not matter.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    hashes = df.select(F.unhex(F.sha1(row.cast("binary"))).alias("h")).distinct()
    words = hashes.select(*[F.xxhash64("h", F.lit(i)).alias(f"w{i}") for i in range(3)])
    return words.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.bit_xor(f"w{i}"), F.lit(0)).alias(f"x{i}") for i in range(3)],
        F.coalesce(F.sum(F.col("w0").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("s0"),
    ).select(F.sha1(F.to_json(F.struct("*")).cast("binary")).alias("mark"))


def _last_mark(df: DataFrame, path: str) -> str | None:
    marks = lambda: df.sparkSession.read.schema("version bigint, mark string").json(f"{path}/marks").agg(F.max_by("mark", "version")).first()
    last = when_written(marks)
    return last[0] if last else None


def refill_if_changed(df: DataFrame, path: str) -> bool:
    """Publish the rows unless the current version has the same content."""
    mark = content_mark(df).first()["mark"]
    if mark == _last_mark(df, path):
        return False
    version = publish(df, path)
    note = df.sparkSession.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(mark).alias("mark")
    )
    note.coalesce(1).write.mode("append").json(f"{path}/marks")
    return True


def as_dictionary(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """One value per key (the smallest, where several compete)."""
    return df.groupBy(col(key).alias("key")).agg(F.min(col(value)).alias("value"))


def refill_dictionary(df: DataFrame, key: Column | str, value: Column | str, path: str) -> int:
    return publish(as_dictionary(df, key, value), path)


def dictionary_lookup(df: DataFrame, key: Column | str, path: str, name: str) -> DataFrame:
    """Look a key up in a refilled dictionary; a missing key is empty."""
    found = read_snapshot(df.sparkSession, path).select(F.col("key").alias("__key"), F.col("value").alias(name))
    return df.join(found, col(key) == F.col("__key"), "left").drop("__key")


def refill_with(df: DataFrame, consume: Callable[[DataFrame], None]) -> None:
    """A user-written sink for the rows."""
    consume(df)
