"""Compare a plan with its SQL, value by value."""

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in values)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql):
    cursor = con.execute(sql)
    return rows([c[0] for c in cursor.description], cursor.fetchall())


def difference(spark, plan, con, folder):
    """None if equal, else a short description."""
    ours, theirs = of_spark(plan(spark, folder)), of_sql(con, plan.sql)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"ours {a[:6]} != {b[:6]}"
    return None
