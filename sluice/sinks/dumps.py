"""Side outputs that let the rows pass: dumps, monitors, flow counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.semantics import all_of, col, is_true


def dump_frame(df: DataFrame, **labelled: Column | str) -> DataFrame:
    return df.select(*[col(e).alias(n) for n, e in labelled.items()])


def dump_all_frame(df: DataFrame) -> DataFrame:
    """All columns in alphabetical order."""
    return df.select(*sorted(df.columns))


def _write(df: DataFrame, path: str) -> None:
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\0").csv(path)


def dump(df: DataFrame, path: str, **labelled: Column | str) -> DataFrame:
    """Write labelled values as tab-separated text with a header; rows pass through."""
    _write(dump_frame(df, **labelled), path)
    return df


def dump_all(df: DataFrame, path: str) -> DataFrame:
    _write(dump_all_frame(df), path)
    return df


def monitor_counts(df: DataFrame, **labels: Column | str) -> DataFrame:
    """Rows per label set."""
    return df.groupBy(*[col(e).alias(n) for n, e in labels.items()]).agg(F.count(F.lit(1)).alias("rows"))


def monitor(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Aggregate metrics gathered while the rows pass through."""
    seen = Observation(name)
    columns = [e.alias(n) for n, e in metrics.items()] or [F.count(F.lit(1)).alias("rows")]
    return df.observe(seen, *columns), seen


def flow_counts(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that survive each filter in turn, counted in one pass."""
    passed = [is_true(all_of(c for _, c in stages[: i + 1])) for i in range(len(stages))]
    counted = df.agg(F.count(F.lit(1)).alias("c0"), *[F.count_if(p).alias(f"c{i + 1}") for i, p in enumerate(passed)])
    names = ["input", *[n for n, _ in stages]]
    report = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.col(f"c{i}").alias("rows"))
        for i, n in enumerate(names)
    ])
    return counted.select(F.inline(report))


class Flow:
    """Row counts of a pipeline, observed while a sink consumes it."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        watched, seen = monitor(df, f"{len(self._seen)}-{name}")
        self._seen.append((name, seen))
        return watched

    def report(self) -> Mapping[str, int]:
        return {name: seen.get["rows"] for name, seen in self._seen}
