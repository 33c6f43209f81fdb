"""Rows dealt out to named streams by one read and one write.

Filtering the rows once for what is kept and once for what is rejected reads
the source twice.  Here every row gets the name of its stream, one write
partitioned by it takes all rows, and the streams are read from what was
written, each by itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.semantics import is_true
from sluice.sources.snapshots import when_written

_STREAM = "__stream"


class Streams(Mapping[str, DataFrame]):
    """The streams that ``deal`` has written, by name; one without rows is empty."""

    def __init__(self, spark, path: str, schema, names: list[str]):
        self.spark, self.path, self.schema, self.names = spark, path, schema, names

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        found = when_written(lambda: self.spark.read.schema(self.schema).parquet(f"{self.path}/{_STREAM}={name}"))
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def deal(df: DataFrame, path: str, rules: Mapping[str, Column], rest: str = "kept") -> Streams:
    """Write every row once, to the first stream whose condition holds, else to ``rest``; ``path`` must be new.

    Names are letters, digits, dashes and underscores.
    """
    names = [*rules, rest]
    if len(set(names)) < len(names) or not all(n.replace("-", "").replace("_", "").isalnum() for n in names):
        raise ValueError(f"streams need different plain names: {names}")
    stream = F.lit(rest)
    for name, condition in reversed(rules.items()):
        stream = F.when(is_true(condition), F.lit(name)).otherwise(stream)
    df.withColumn(_STREAM, stream).write.partitionBy(_STREAM).parquet(path)
    return Streams(df.sparkSession, path, df.schema, names)


def reject_once(df: DataFrame, condition: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows)."""
    streams = deal(df, path, {"rejected": condition})
    return streams["kept"], streams["rejected"]


def require_once(df: DataFrame, name: str, optional: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the optional value bound, rows in which it is empty)."""
    streams = deal(df.withColumn(name, optional), path, {"rejected": F.col(name).isNull()})
    return streams["kept"], streams["rejected"].select(*df.columns)


def drain_once(df: DataFrame, condition: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows taken out, rows that stay)."""
    streams = deal(df, path, {"taken": condition})
    return streams["taken"], streams["kept"]
