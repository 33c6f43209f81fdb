"""Versioned snapshots of a table, batches added beside them, and merge by id.

Data are written in full to a folder of their own; then a file of a log names
the folder, and only then do readers see it.  Nothing that was written is ever
changed, so readers and failed writers disturb nobody.  The file of version n
is made only if there is none yet.  A writer whose version was made from an
older one (``update``) and who finds the next number taken reads again and
makes its version anew, so of two writers at once neither loses rows.  Of two
writings of one batch the one with the greater stamp counts.  ``expire`` removes
what no reader needs, with its lines.
"""

from __future__ import annotations

import json
import logging
import random
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sluice.semantics import join_same
from sluice.sources.folders import put_new, remove

log = logging.getLogger("sluice")

_LINE = "version bigint, stamp string, folder string, format string, upto bigint"
_BATCH = "batch bigint, stamp string, folder string"
# The error classes of a folder that has not been written yet.
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def when_written(read):
    """The result of ``read()``, or nothing if its folder does not exist yet; other errors are errors."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in _ABSENT:
            return None
        raise


def _stamp() -> str:
    """Ascending with time, different for every writer."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


class Overtaken(RuntimeError):
    """Another writer made the next version first."""


def _current(spark: SparkSession, path: str) -> Row | None:
    line = when_written(lambda: spark.read.schema(_LINE).json(f"{path}/current").agg(F.max(F.struct("version", "stamp", "folder", "format", "upto")).alias("l")).first())
    return line["l"] if line else None


def current_version(spark: SparkSession, path: str) -> int | None:
    line = _current(spark, path)
    return line["version"] if line else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    line = _current(spark, path)
    return None if line is None else _read(spark, path, line)


def _read(spark: SparkSession, path: str, line: Row) -> DataFrame:
    return spark.read.format(line["format"]).load(f"{path}/{line['folder']}")


def publish(df: DataFrame, path: str, upto: int | None = None, fmt: str = "parquet") -> int:
    """Write the next version and make it the current one, whatever was there.

    ``upto`` is the number of the last batch the version holds (default: as before).
    """
    spark = df.sparkSession
    folder, stamp = _written(df, path, fmt)
    while True:
        line = _current(spark, path)
        version = (line["version"] if line else 0) + 1
        if _named(spark, path, version, stamp, folder, fmt, upto if upto is not None else line["upto"] if line else -1):
            return version


def _written(df: DataFrame, path: str, fmt: str) -> tuple[str, str]:
    stamp = _stamp()
    folder = f"v={stamp}"
    df.write.format(fmt).save(f"{path}/{folder}")
    return folder, stamp


def _named(spark: SparkSession, path: str, version: int, stamp: str, folder: str, fmt: str, upto: int) -> bool:
    line = {"version": version, "stamp": stamp, "folder": folder, "format": fmt, "upto": upto}
    return put_new(spark, f"{path}/current/{version:020d}.json", json.dumps(line) + "\n")


def update(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], upto: int | None = None, tries: int = 20) -> int:
    """Make the next version from the current one, again if another writer was first.

    ``make`` gets the rows of the current version, or nothing.  It may run
    several times.
    """
    for attempt in range(tries):
        line = _current(spark, path)
        df = make(None if line is None else _read(spark, path, line))
        folder, stamp = _written(df, path, "parquet")
        version = (line["version"] if line else 0) + 1
        if _named(spark, path, version, stamp, folder, "parquet", upto if upto is not None else line["upto"] if line else -1):
            return version
        remove(spark, f"{path}/{folder}")
        time.sleep(random.uniform(0, 0.05 * 2 ** min(attempt, 6)))
    raise Overtaken(f"{tries} times another writer was first at {path}")


def add_batch(df: DataFrame, path: str, batch: int) -> None:
    """Store one micro-batch beside the snapshot; storing it again replaces it."""
    stamp = _stamp()
    folder = f"added/batch-{batch}-{stamp}"
    df.write.parquet(f"{path}/{folder}")
    line = {"batch": batch, "stamp": stamp, "folder": folder}
    put_new(df.sparkSession, f"{path}/batches/{batch:020d}-{stamp}.json", json.dumps(line) + "\n")


def _batches(spark: SparkSession, path: str) -> list[Row]:
    """The last writing of each batch that the snapshot does not hold yet."""
    line = _current(spark, path)
    held = line["upto"] if line else -1
    read = lambda: spark.read.schema(_BATCH).json(f"{path}/batches").filter(F.col("batch") > held).groupBy("batch").agg(F.max_by("folder", "stamp").alias("folder")).collect()
    return when_written(read) or []


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the stored micro-batches, or nothing if there is none."""
    folders = [f"{path}/{r['folder']}" for r in _batches(spark, path)]
    return spark.read.parquet(*folders) if folders else None


def compact(spark: SparkSession, path: str, scan) -> int | None:
    """Put the batches into a new snapshot; ``scan()`` reads the table whole.

    A batch that comes again later is known by its number and left out.
    """
    batches = _batches(spark, path)
    return update(spark, path, lambda _: scan(), upto=max(r["batch"] for r in batches)) if batches else None


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the data of all but the last ``keep`` versions, and of batches that the current one holds.

    Readers of older versions must be done.  Their lines go after their data, so
    that a call that was interrupted is made good by the next.
    """
    line = _current(spark, path)
    if line is None:
        return
    old = spark.read.schema(_LINE).json(f"{path}/current").orderBy(F.desc("version")).collect()[keep:]
    held = when_written(lambda: spark.read.schema(_BATCH).json(f"{path}/batches").filter(F.col("batch") <= line["upto"]).collect()) or []
    for r in old:
        remove(spark, f"{path}/{r['folder']}")
        remove(spark, f"{path}/current/{r['version']:020d}.json")
    for r in held:
        remove(spark, f"{path}/{r['folder']}")
        remove(spark, f"{path}/batches/{r['batch']:020d}-{r['stamp']}.json")


def snapshot_replace(df: DataFrame, path: str) -> bool:
    """Replace the snapshot, or keep the old one (and say why in the log) if the new rows cannot be read."""
    try:
        publish(df, path)
    except Exception:  # whatever made the source bad, the earlier version stays current
        if current_version(df.sparkSession, path) is None:
            raise
        log.warning("kept the snapshot at %s", path, exc_info=True)
        return False
    return True


def incremental_merge(old: DataFrame, new: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Old rows with new ones added; the new row of an id (empty ones too) wins."""
    return join_same(old, new.select(*ids).distinct(), list(ids), "left_anti").unionByName(new)
