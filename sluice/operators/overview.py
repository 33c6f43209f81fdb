"""Overview statistics over the action table (or any frame with a row id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.semantics import col, cut_lineage

# Narrowest histogram bucket (ms) and the cross-table size limits.
MIN_BUCKET_MS = 60_000
LONG_AXIS, SHORT_AXIS = 40, 20


def _values(df: DataFrame, name: str, prop: Column) -> Column:
    kind = df.select(prop.alias(name)).schema[name].dataType.typeName()
    return prop if kind == "array" else F.array(prop)


def property_rows(df: DataFrame, id_: str, properties: Mapping[str, Column | str]) -> DataFrame:
    """One row per (row id, property, distinct value); values as text."""
    listed = F.array(*[
        F.struct(F.lit(n).alias("property"), _values(df, n, col(p)).cast("array<string>").alias("values"))
        for n, p in properties.items()
    ])
    rows = df.select(F.col(id_).alias("id"), F.explode(listed).alias("p"))
    return rows.select("id", "p.property", F.explode(F.array_distinct("p.values")).alias("value"))


def property_summary(df: DataFrame, id_: str, properties: Mapping[str, Column | str]) -> DataFrame:
    """Rows per value of each (possibly multi-valued) property; ids are unique."""
    return property_rows(df, id_, properties).groupBy("property", "value").agg(F.count(F.lit(1)).alias("total"))


def _marks(r: Column, c: Column) -> Column:
    """What one row adds to a cross table: itself, its values, its pairs of values."""
    kind = "struct<kind:string,r:string,c:string>"

    def mark(name: str, row: Column | None, column: Column | None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("kind"), (none if row is None else row).alias("r"), (none if column is None else column).alias("c")
        ).cast(kind)

    return F.concat(
        F.array(mark("all", None, None)),
        F.transform(r, lambda x: mark("row", x, None)),
        F.transform(c, lambda y: mark("column", None, y)),
        F.flatten(F.transform(r, lambda x: F.transform(c, lambda y: mark("cell", x, y)))),
    )


def crosstab_counts(df: DataFrame, row: Column | str, column: Column | str) -> DataFrame:
    """Counts of two properties (as text), the longer axis as rows.

    Values found on every row are left out.  The rows are read once; the
    counts are stored, and the rest works on them.
    """
    r = F.array_distinct(_values(df, "r", col(row)).cast("array<string>"))
    c = F.array_distinct(_values(df, "c", col(column)).cast("array<string>"))
    marks = df.select(F.explode(_marks(r, c)).alias("m")).select("m.*")
    counted = cut_lineage(marks.groupBy("kind", "r", "c").agg(F.count(F.lit(1)).alias("n")))

    def only(kind: str) -> DataFrame:
        return counted.filter(F.col("kind") == kind)

    total = only("all").select("n")
    rows = only("row").filter(F.col("n") < total.scalar()).select("r")
    columns = only("column").filter(F.col("n") < total.scalar()).select("c")
    n_rows = rows.agg(F.count(F.lit(1))).scalar()
    n_columns = columns.agg(F.count(F.lit(1))).scalar()
    cells = only("cell").join(rows, "r", "left_semi").join(columns, "c", "left_semi")
    tall = n_rows >= n_columns
    return cells.select(
        F.when(tall, F.col("r")).otherwise(F.col("c")).alias("row_value"),
        F.when(tall, F.col("c")).otherwise(F.col("r")).alias("column_value"),
        "n",
    )


def crosstab_display(counts: DataFrame) -> DataFrame:
    """The table if it is fit to be shown: two values or more on each axis, and no more than the fixed size limits."""
    size = counts.agg(F.count_distinct("row_value").alias("r"), F.count_distinct("column_value").alias("c"))
    fit = (F.least("r", "c") >= 2) & (F.greatest("r", "c") <= LONG_AXIS) & (F.least("r", "c") <= SHORT_AXIS)
    return counts.filter(size.select(fit).scalar())


def _range(members: Mapping[str, str]) -> tuple[Column, Column]:
    """First and last time (ms) over all members."""
    times = [F.unix_millis(F.col(c)) for c in members.values()]
    lows, highs = [F.min(t) for t in times], [F.max(t) for t in times]
    return (F.least(*lows), F.greatest(*highs)) if len(times) > 1 else (lows[0], highs[0])


def _frame(span: DataFrame, buckets: int) -> DataFrame:
    """One row of lo, hi (ms) to a struct of start, bucket width (ms) and bucket count; no row without times."""
    even = F.expr(f"(hi - lo) div {buckets}")
    narrow = even < MIN_BUCKET_MS
    return span.filter("lo IS NOT NULL").select(F.struct(
        "lo", "hi", F.when(narrow, F.lit(MIN_BUCKET_MS)).otherwise(even).cast("bigint").alias("width"),
        F.when(narrow, F.expr(f"(hi - lo) div {MIN_BUCKET_MS}") + 1).otherwise(F.lit(buckets)).cast("bigint").alias("n"),
    ).alias("f"))


def _counted(df: DataFrame, members: Mapping[str, str], frame: DataFrame, extra: Sequence[Column]) -> DataFrame:
    """Rows per member, bucket and extra columns."""
    times = F.array(*[F.struct(F.lit(m).alias("member"), F.unix_millis(F.col(c)).alias("at")) for m, c in members.items()])
    rows = df.select(*extra, F.explode(times).alias("t"), frame.scalar().alias("f")).filter(F.col("t.at").isNotNull())
    bucket = F.least(F.expr("(t.at - f.lo) div f.width"), F.col("f.n") - 1)
    keys = [c for c in rows.columns if c not in ("t", "f")]
    return rows.select(*keys, F.col("t.member").alias("member"), bucket.alias("bucket")).groupBy(*keys, "member", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _grid(frame: DataFrame, members: Mapping[str, str]) -> DataFrame:
    """Every bucket of every member with its boundaries (ms): members times ``buckets`` rows."""
    each = frame.select("f", F.explode(F.array(*[F.lit(m) for m in members])).alias("member"))
    each = each.select("f", "member", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("f.n") - 1)).alias("bucket"))
    start = F.col("f.lo") + F.col("bucket") * F.col("f.width")
    end = F.when(F.col("bucket") == F.col("f.n") - 1, F.greatest(F.col("f.hi"), start + F.col("f.width"))).otherwise(start + F.col("f.width"))
    return each.select("member", "bucket", start.alias("start_ms"), end.alias("end_ms"))


def histogram(df: DataFrame, members: Mapping[str, str], buckets: int = 100) -> DataFrame:
    """Equal-width time buckets over the joint range of all members, with their boundaries.

    Each member is counted by itself, and every bucket is listed, empty ones
    with zero.  The last bucket takes what the widths leave over.  One single
    time has one bucket; without times there is none.
    """
    lo, hi = _range(members)
    frame = _frame(df.agg(lo.alias("lo"), hi.alias("hi")), buckets)
    counted = _counted(df, members, frame, [])
    return _grid(frame, members).join(counted, ["member", "bucket"], "left").fillna(0, ["n"])


def histogram_by_property(
    df: DataFrame, members: Mapping[str, str], prop: Column | str, buckets: int = 100
) -> DataFrame:
    """The same, split by the values of a property that is not on every row.

    Nothing is listed with fewer than two such values.  One read gives the
    range and the rows per value, another the counts.
    """
    keyed = df.withColumn("__p", F.array_distinct(_values(df, "p", col(prop))))
    lo, hi = _range(members)
    no_value = F.when(F.lit(False), F.get("__p", F.lit(0)))
    marks = F.concat(
        F.array(F.struct(F.lit(True).alias("all"), no_value.alias("v"))), F.transform("__p", lambda x: F.struct(F.lit(False).alias("all"), x.alias("v")))
    )
    spans = keyed.withColumn("__m", F.explode(marks)).groupBy(F.col("__m.all").alias("all"), F.col("__m.v").alias("v")).agg(
        F.count(F.lit(1)).alias("rows"), lo.alias("lo"), hi.alias("hi")
    )
    spans = cut_lineage(spans)
    frame = _frame(spans.filter("all").select("lo", "hi"), buckets)
    shown = spans.filter(~F.col("all")).filter(F.col("rows") < spans.filter("all").select("rows").scalar()).select("v")
    enough = shown.agg(F.count(F.lit(1))).scalar() >= 2
    counted = _counted(keyed.withColumn("v", F.explode("__p")), members, frame, [F.col("v")])
    buckets_of = F.array_agg(F.struct("member", "bucket", "start_ms", "end_ms"))  # members times buckets entries
    grid = shown.filter(enough).select("v", F.explode(_grid(frame, members).agg(buckets_of).scalar()).alias("g")).select("v", "g.*")
    full = grid.join(counted, ["v", "member", "bucket"], "left").fillna(0, ["n"])
    return full.select("member", F.col("v").alias("value"), "bucket", "start_ms", "end_ms", "n")


def latest_transitions(df: DataFrame, state: str, type_: str, at: str) -> DataFrame:
    """Latest state transition per state and type."""
    return df.groupBy(state, type_).agg(F.max(at).alias("last_transition"))


def action_sort(df: DataFrame, id_: str, key: Column | str | None = None) -> DataFrame:
    """Largest sort key first, missing keys last, ties by id."""
    if key is None:
        return df.orderBy(F.asc(id_))
    return df.orderBy(F.desc_nulls_last(key) if isinstance(key, str) else key.desc_nulls_last(), F.asc(id_))


def action_page(df: DataFrame, id_: str, key: Column | str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """``limit`` rows in the order of ``action_sort`` after the first ``skip``.

    Each task keeps only its first ``skip + limit`` rows, so the table is never sorted whole.
    """
    if skip < 0 or limit < 1:
        raise ValueError(f"a page needs skip >= 0 and limit >= 1, not {skip} and {limit}")
    return action_sort(df, id_, key).limit(skip + limit).offset(skip)


def tag_list(df: DataFrame, tags: Column | str, condition: Column | None = None) -> DataFrame:
    """Every tag of the matching rows, once each."""
    chosen = df if condition is None else df.filter(condition)
    return chosen.select(F.explode(col(tags)).alias("tag")).distinct()


def count_matching(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition).agg(F.count(F.lit(1)).alias("n"))


def drain(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows taken out, rows that stay)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(hit), df.filter(~hit)
