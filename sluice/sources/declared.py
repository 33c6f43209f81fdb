"""Input formats with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.clauses import Gangs
from sluice.semantics import col
from sluice.sources.arrays import array_items

ISO, SECONDS, MILLIS = "iso", "seconds", "millis"

# Names of the time encodings and type codes in schema files.
TIME_FORMATS = {"ISO8660_STRING": ISO, "SECONDS_NUMERIC": SECONDS, "MILLIS_NUMERIC": MILLIS}
SCALARS = {
    "i": T.LongType(),
    "f": T.DoubleType(),
    "s": T.StringType(),
    "b": T.BooleanType(),
    "d": T.TimestampType(),
    "p": T.StringType(),
    "j": T.StringType(),
}


def type_of(code: str) -> T.DataType:
    """Spark type of a flat type code: scalar, optional, list or dictionary of scalars."""
    if code in SCALARS:
        return SCALARS[code]
    if code[0] == "q":
        return type_of(code[1:])
    if code[0] == "a":
        return T.ArrayType(type_of(code[1:]))
    if code[0] == "m" and len(code) == 3:
        return T.MapType(type_of(code[1]), type_of(code[2]))
    if code[0] == "t" and code[1].isdigit():
        n = int(code[1])
        return T.StructType([T.StructField(f"_{i}", type_of(c)) for i, c in enumerate(code[2 : 2 + n])])
    raise ValueError(f"unsupported type code {code!r}")


@dataclass(frozen=True)
class Format:
    """A named, typed table with its signable columns, gangs and date encoding."""

    schema: T.StructType
    signable: tuple[str, ...] = ()
    gangs: Gangs = field(default_factory=Gangs)
    time: str = ISO

    def wire_schema(self) -> T.StructType:
        """The schema on disk, with dates in their encoded form."""
        encoded = {ISO: T.StringType(), SECONDS: T.DoubleType(), MILLIS: T.LongType()}[self.time]
        return T.StructType([
            T.StructField(f.name, encoded if isinstance(f.dataType, T.TimestampType) else f.dataType)
            for f in self.schema
        ])


def schema_from_descriptor(text: str) -> Format:
    """A format from the JSON text of a schema file."""
    described = json.loads(text)
    variables = described["variables"]
    schema = T.StructType([T.StructField(n, type_of(v["type"])) for n, v in variables.items()])
    members: dict[str, list[tuple[int, str, bool]]] = {}
    for n, v in variables.items():
        for g in v.get("gangs", []):
            members.setdefault(g["gang"], []).append((g["order"], n, g["dropIfDefault"]))
    empty = {"s": "", "p": "", "i": 0}
    gangs = {
        g: [(n, empty.get(variables[n]["type"])) if drop else n for _, n, drop in sorted(ms)]
        for g, ms in members.items()
    }
    return Format(
        schema, tuple(n for n, v in variables.items() if v.get("signable")), Gangs(**gangs),
        TIME_FORMATS[described.get("timeFormat", "ISO8660_STRING")],
    )


def time_decode(value: Column | str, encoding: str) -> Column:
    """A date from ISO text, seconds (with a fraction) or milliseconds."""
    v = col(value)
    if encoding == ISO:
        return F.to_timestamp(v)
    if encoding == SECONDS:
        return F.timestamp_micros(F.round(v * 1_000_000).cast("bigint"))
    return F.timestamp_millis(v.cast("bigint"))


def scan_declared(spark: SparkSession, fmt: Format, path: str, kind: str = "json") -> DataFrame:
    """Read a format.

    ``json`` files hold one array of objects per file and are read by byte
    range; ``jsonl`` has a row per line.  A record that does not fit the schema
    fails the read.
    """
    if kind == "parquet":
        return spark.read.schema(fmt.schema).parquet(path)
    reader = spark.read.schema(fmt.wire_schema()).option("mode", "FAILFAST")
    if kind == "csv":
        df = reader.option("header", True).csv(path)
    elif kind == "json":
        record = F.from_json("item", fmt.wire_schema(), {"mode": "FAILFAST"})
        df = array_items(spark, path).select(record.alias("r")).select("r.*")
    else:
        df = reader.json(path)
    dates = {f.name for f in fmt.schema if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[
        time_decode(f.name, fmt.time).alias(f.name) if f.name in dates else _as_list_set(f).alias(f.name)
        for f in fmt.schema
    ])


def _as_list_set(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.ArrayType):
        return F.sort_array(F.array_distinct(F.col(f.name)))
    return F.col(f.name)


def scan_union(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources of one format together; any that fails stops the job."""
    return reduce(DataFrame.unionByName, sources)
