"""The plan registry and the declared tables the plans read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from sluice.semantics import pin_session

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp,"
        " o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """The input tables of a folder, read with their declared schemas."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin_session(spark)
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))


Run = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    run: Run
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function of the tables under an operator name."""

    def register(run: Run) -> Run:
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = Plan(name, run, " ".join(sql.split()) if sql else None)
        return run

    return register


def columns(
    name: str, table: str, keys: Sequence[str], computed: Callable[[], Mapping[str, Column]], sql: Mapping[str, str]
) -> None:
    """Register a projection of computed columns over a whole table."""
    listed = ", ".join([*keys, *[f"{expression} AS {alias}" for alias, expression in sql.items()]])

    @plan(name, f"SELECT {listed} FROM {table}")
    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(*keys, *[c.alias(n) for n, c in computed().items()])
