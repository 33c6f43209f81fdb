"""What users can add: functions, constants, collectors, groupers, sub-pipelines, sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sluice.functions.exprs import units
from sluice.functions.registered import plugin, sql_function, variadic
from sluice.operators import collectors as c
from sluice.operators.grouping import group_by
from sluice.operators.groupers import grouped_map
from sluice.plans.clauses import cents, priority_orders
from sluice.plans.grouping import tally
from sluice.plans.registry import Tables, plan
from sluice.semantics import scratch_path
from sluice.sinks.partitioned import FilesSink, refill_partitions
from sluice.sinks.refills import refill_with


@plan("udf_function", """
    SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 7) AS BIGINT) + l_linenumber AS shelf FROM lineitem
""")
def udf_function(t: Tables):
    sql_function(t.spark, "shelf_of", {"quantity": "double", "line": "int"}, "bigint", "CAST(floor(quantity / 7) AS BIGINT) + line")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.call_function("shelf_of", "l_quantity", "l_linenumber").alias("shelf"))


BULK = 30
QUOTA = units(2, "k")


@plan("udf_constant", "SELECT l_orderkey, l_linenumber, l_quantity > 30 AS bulk, l_partkey * 2000 AS quota FROM lineitem")
def udf_constant(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > BULK).alias("bulk"), (F.col("l_partkey") * QUOTA).alias("quota"))


def initials():
    """A vectorised function, made here so that it travels to the workers by itself."""

    def shorten(names: pd.Series) -> pd.Series:
        return names.str.replace(r"(\w)\w*\s*", r"\1", regex=True)

    return shorten


@plan("udf_plugin", r"""
    SELECT p_partkey, regexp_replace(p_name, '(\w)\w*\s*', '\1', 'g') AS initials, p_brand || '-' || p_type || '-' || p_name AS label FROM part
""")
def udf_plugin(t: Tables):
    dashed = variadic(lambda a, b: F.concat(a, F.lit("-"), b))
    return t.part.select("p_partkey", plugin(initials(), "string")("p_name").alias("initials"), dashed(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("label"))


def spread(value):
    """A user collector from mergeable parts: largest less smallest."""
    v = F.col(value)
    high, low = c.maximum(v), c.minimum(v)
    return c.Collector(high.parts + low.parts, lambda hi, lo: hi - lo, lambda hi, lo: hi.isNotNull())


@plan("udaf_collector", "SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_suppkey")
def udaf_collector(t: Tables):
    return group_by(t.lineitem, ["l_suppkey"], {"spread": spread("l_quantity")})


@plan("agg_stats", """
    SELECT l_suppkey, avg(l_linenumber) AS average, count(*) AS count, max(l_linenumber) AS maximum, min(l_linenumber) AS minimum,
        CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem GROUP BY l_suppkey
""")
def agg_stats(t: Tables):
    return group_by(t.lineitem, ["l_suppkey"], {"s": c.stats("l_linenumber")}).select("l_suppkey", "s.*")


@plan("udtf_grouper", "SELECT l_returnflag, l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag, l_suppkey")
def udtf_grouper(t: Tables):
    lines = t.lineitem.select("l_returnflag", "l_suppkey", "l_quantity")
    return grouped_map(lines, ["l_returnflag", "l_suppkey"], tally("l_returnflag", "l_suppkey"), "l_returnflag string, l_suppkey bigint, n bigint, quantity double")


@plan("udtf_define", "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE o_orderpriority = '3-MEDIUM'")
def udtf_define(t: Tables):
    return t.orders.transform(priority_orders, "3-MEDIUM")


@plan("udf_refiller", """
    SELECT o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderstatus
""")
def udf_refiller(t: Tables):
    path = scratch_path(t.spark, "custom")
    refill_with(t.orders, lambda rows: rows.write.partitionBy("o_orderstatus").parquet(path))
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.sum(cents("o_totalprice")).alias("cents"))


@plan("udf_refiller_partitions", """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderstatus
""")
def udf_refiller_partitions(t: Tables):
    sink = FilesSink(scratch_path(t.spark, "sink"))
    # the second content replaces the first whole
    refill_partitions(t.orders.select("o_orderkey"), sink)
    refill_partitions(t.orders.select("o_orderstatus", cents("o_totalprice").alias("cents")), sink)
    found = sink.read(t.spark, "o_orderstatus string, cents bigint")
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
