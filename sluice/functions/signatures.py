"""Row signatures over the signable columns a pipeline has read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signable_read(signable: Sequence[str], read: Sequence[str]) -> list[str]:
    """The signable columns among those read before the first reshape."""
    return sorted(set(signable) & set(read))


def count(columns: Sequence[str]) -> Column:
    return F.lit(len(set(columns))).cast("bigint")


def names(columns: Sequence[str]) -> Column:
    ordered = sorted(set(columns))
    return F.array(*[F.lit(c) for c in ordered]) if ordered else F.array().cast("array<string>")


def as_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*sorted(set(columns)))) if columns else F.lit("{}")


def sha1(columns: Sequence[str]) -> Column:
    """SHA-1 over ``name:value`` of each column, values as JSON."""
    parts = [F.concat(F.lit(f"{c}:"), F.to_json(F.array(c))) for c in sorted(set(columns))]
    return F.upper(F.sha1(F.concat(*parts).cast("binary") if parts else F.lit("").cast("binary")))


def key_id(key: Column) -> Column:
    """Provider and id of an external key."""
    return F.struct(key["id"].alias("id"), key["provider"].alias("provider"))


def key_sign(key: Column, signature: Column, label: str = "sha1") -> Column:
    """Add a signature to the version map of an external key."""
    return key.withField("versions", F.map_concat(key["versions"], F.create_map(F.lit(label), signature)))
