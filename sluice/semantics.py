"""Rules shared by every operator.

* Plain columns are never null; a nullable column is an *optional* value, and
  two empty optionals are equal (``same``).
* A list value is a sorted set (``as_set``).
* Dates are UTC instants, so the session time zone is pinned (``pin_session``).
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # later entries of a dictionary literal replace earlier ones
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Bytes as shuffled: rows of few columns grow tenfold and more when a task sorts them.
_UNLESS_NAMED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def pin_session(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators rely on, and bound the size of tasks unless the session does."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in _UNLESS_NAMED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def travels(module: str) -> None:
    """Send what a module defines to the tasks by value, so that executors need not have this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_true(condition: Column | str) -> Column:
    """A condition with unknown counted as false."""
    return F.coalesce(col(condition), F.lit(False))


def same(a: Column | str, b: Column | str) -> Column:
    """Equality in which two empty optionals are equal."""
    return col(a).eqNullSafe(col(b))


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equality join on columns of one name, in which two empty optionals are equal; keys come once, from the left."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    if hint:
        left, other = left.hint(hint), other.hint(hint)
    return left.join(other, all_of(same(k, f"__same_{k}") for k in keys), how).drop(*[f"__same_{k}" for k in keys])


def as_set(items: Column | str) -> Column:
    """Normalise a list: distinct items in ascending order (an empty one first)."""
    return F.sort_array(F.array_distinct(col(items)))


def bind(value: Column, body) -> Column:
    """Evaluate a column once per row and use it several times.

    Inside a lambda, an expression would be evaluated again for every item.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full_match(text: Column | str, pattern: str, flags: str = "") -> Column:
    """Whole-string regular expression match; ``flags`` from ``imsux``."""
    inline = f"(?{flags})" if flags else ""
    return col(text).rlike(rf"{inline}\A(?:{pattern})\z")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session that names none falls back to a fresh local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sluice-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
