"""Analysis runs checked against the reference records they used."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provenance:
    good: DataFrame
    stale: DataFrame
    skipped: DataFrame
    missing: DataFrame


def provenance_rows(
    runs: DataFrame, records: DataFrame, key: Sequence[str], run_version: str, record_version: str, skip: str
) -> DataFrame:
    """Every run with its record and an ``outcome``.

    A run without a record is ``missing``; a run whose record is to be skipped
    is ``skipped``; then ``stale`` if the versions differ, else ``good``.
    ``is_stale`` is also told for skipped rows.  Of records with one key the
    largest version counts, so a run is told once.
    """
    latest = F.max(F.struct(record_version, skip))
    found = records.groupBy(*key).agg(latest.alias("__record")).select(*key, "__record.*", F.lit(True).alias("__found"))
    joined = runs.join(found, list(key), "left")
    stale = F.coalesce(F.col(run_version) != F.col(record_version), F.lit(True))
    outcome = (
        F.when(F.col("__found").isNull(), "missing").when(F.col(skip), "skipped").when(stale, "stale")
        .otherwise("good")
    )
    return joined.withColumn("outcome", outcome).withColumn("is_stale", stale).drop("__found")


def provenance_join(
    runs: DataFrame, records: DataFrame, key: Sequence[str], run_version: str, record_version: str, skip: str
) -> Provenance:
    """The four streams of :func:`provenance_rows`."""
    rows = provenance_rows(runs, records, key, run_version, record_version, skip)

    def only(outcome: str) -> DataFrame:
        return rows.filter(F.col("outcome") == outcome).drop("outcome")

    return Provenance(only("good"), only("stale"), only("skipped"), only("missing"))
