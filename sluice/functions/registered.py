"""User functions: column functions, constants, vectorised plugins, SQL names."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def sql_function(spark: SparkSession, name: str, arguments: Mapping[str, str], returns: str, body: str) -> None:
    """Make an expression callable by name from SQL."""
    signature = ", ".join(f"{a} {t}" for a, t in arguments.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {body}")


def plugin(function: Callable, returns: str) -> Callable[..., Column]:
    """A vectorised function of whole columns (pandas series in, series out)."""
    return F.pandas_udf(function, returns)


def variadic(combine: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    """A function of any number of columns from a function of two."""

    def call(*columns: Column) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = combine(out, c)
        return out

    return call
