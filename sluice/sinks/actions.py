"""Rows to deduplicated actions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.predicates import Origin
from sluice.semantics import col
from sluice.sources.snapshots import read_batches, read_snapshot, update

# The states of an action.
STATES = (
    "FAILED", "HALP", "INFLIGHT", "QUEUED", "SAFETY_LIMIT_REACHED", "SUCCEEDED", "THROTTLED", "UNKNOWN", "WAITING",
    "ZOMBIE",
)

LOCATION = "struct<file:string,line:bigint,column:bigint,hash:string>"


def optional_param(condition: Column, value: Column) -> Column:
    """A parameter that is absent unless the condition holds."""
    return F.when(condition, value)


def tags(*single: Column, lists: tuple[Column, ...] = ()) -> Column:
    """Single tags and lists of tags together, each once."""
    return F.array_distinct(F.concat(F.array(*single).cast("array<string>"), *lists))


def location(origin: Origin) -> Column:
    return F.struct(
        F.lit(origin.file).alias("file"), F.lit(origin.line).cast("bigint").alias("line"),
        F.lit(origin.column).cast("bigint").alias("column"), F.lit(origin.hash).cast("string").alias("hash"),
    ).cast(LOCATION)


def action_id(type_: Column, params: Column) -> Column:
    """Identity of an action: its type and parameters."""
    return F.concat(F.lit("action:"), F.upper(F.sha1(F.concat_ws("\n", type_, params).cast("binary"))))


def emit_actions(
    df: DataFrame, type_: str, params: Mapping[str, Column | str], at: Column | str, origin: Origin,
    tag_list: Column | None = None, external: Column | None = None, priority: int = 0, retry_minutes: int = 10,
) -> DataFrame:
    """One action per distinct parameter set.

    Repeated rows are merged: tags and origins are united, the earliest time
    is ``created`` and the latest ``last_added``.  Empty parameters are left out
    of the identity.  Tags are spread before grouping, so a heavily repeated
    action is reduced on the map side and never gathered.  ``priority`` and
    ``retry`` (minutes) are the action type's; ``changed`` is when its row was
    changed last.
    """
    return merge_rows(action_rows(df, type_, params, at, tag_list, external), type_, origin, priority, retry_minutes)


def action_rows(
    df: DataFrame, type_: str, params: Mapping[str, Column | str], at: Column | str, tag_list: Column | None = None, external: Column | None = None,
) -> DataFrame:
    """One row per row and tag, with the id of its action; nothing is grouped yet, so it may be a stream."""
    ordered = F.to_json(F.struct(*[col(params[n]).alias(n) for n in sorted(params)]))
    rows = df.select(
        ordered.alias("params"), col(at).alias("at"), (F.lit(None).cast("timestamp") if external is None else external).alias("external"),
        F.explode_outer(F.array().cast("array<string>") if tag_list is None else tag_list).alias("tag"),
    )
    return rows.withColumn("id", action_id(F.lit(type_), F.col("params")))


def merge_rows(rows: DataFrame, type_: str, origin: Origin, priority: int = 0, retry_minutes: int = 10) -> DataFrame:
    """The rows of ``action_rows`` as one action per id."""
    merged = rows.groupBy("params").agg(
        F.min("at").alias("created"),
        F.max("at").alias("last_added"),
        F.max("external").alias("external_timestamp"),
        F.sort_array(F.collect_set("tag")).alias("tags"),
    )
    kind = F.lit(type_)
    return merged.select(
        action_id(kind, F.col("params")).alias("id"), kind.alias("type"), "params",
        F.lit("UNKNOWN").alias("state"), "tags", F.array(location(origin)).alias("locations"), "created",
        "last_added", F.timestamp_seconds(F.lit(0)).alias("last_checked"),
        F.col("created").alias("last_state_transition"), "external_timestamp", F.lit(priority).cast("bigint").alias("priority"),
        F.lit(retry_minutes).cast("bigint").alias("retry"), F.col("last_added").alias("changed"),
    )


def fold_actions(rows: DataFrame) -> DataFrame:
    """Several rows per id to one: earliest creation, latest addition, united tags and origins.

    Tags are spread before grouping; repeating a row changes nothing.
    """
    spread = rows.withColumn("__tag", F.explode_outer("tags"))
    return spread.groupBy("id", "type", "params").agg(
        F.max("state").alias("state"),
        F.sort_array(F.collect_set("__tag")).alias("tags"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"),
        F.min("created").alias("created"),
        F.max("last_added").alias("last_added"),
        F.max("last_checked").alias("last_checked"),
        F.min("last_state_transition").alias("last_state_transition"),
        F.max("external_timestamp").alias("external_timestamp"),
        F.max("priority").alias("priority"), F.min("retry").alias("retry"), F.max("changed").alias("changed"),
    )


def action_view(actions: DataFrame) -> DataFrame:
    """The action table under the column names of the action input format."""
    return actions.select(
        "changed", F.col("last_checked").alias("checked"), "created", F.col("last_added").alias("generated"), "last_state_transition", "external_timestamp",
        "id", "state", "type", F.col("params").alias("info"), "locations", "priority", "retry", "tags",
    )


def merge_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add actions to a table: known ones keep their state and creation time.

    Both sides have one row per id, so at most two rows meet.
    """
    ours = old.withColumnsRenamed({c: f"__{c}" for c in old.columns if c != "id"})
    both = ours.join(new, "id", "full_outer")
    known = F.col("__type").isNotNull()

    def kept(c: str) -> Column:
        return F.when(known, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    def united(c: str) -> Column:
        empty = F.array()
        joined = F.array_union(F.coalesce(F.col(f"__{c}"), empty), F.coalesce(F.col(c), empty))
        return F.sort_array(joined).alias(c)

    merged = {
        "tags": united("tags"), "locations": united("locations"),
        "created": F.least("__created", "created").alias("created"),
        "last_added": F.greatest(F.col("__last_added"), F.col("last_added")).alias("last_added"),
        "external_timestamp": F.coalesce("external_timestamp", "__external_timestamp").alias("external_timestamp"),
        "priority": F.coalesce("priority", "__priority").alias("priority"), "retry": F.coalesce("retry", "__retry").alias("retry"),
        "changed": F.greatest(F.col("__changed"), F.col("changed")).alias("changed"),
    }
    return both.select("id", *[merged.get(c, kept(c)) for c in old.columns if c != "id"])


def upsert_actions(path: str, new: DataFrame) -> int:
    """Merge actions into the table at ``path``; repeating the call changes nothing."""
    return update(new.sparkSession, path, lambda old: new if old is None else merge_actions(old, new))


def action_scan(spark: SparkSession, path: str) -> DataFrame:
    """The action table as an input: its snapshot with the batches added since."""
    table, batches = read_snapshot(spark, path), read_batches(spark, path)
    if batches is None:
        if table is None:
            raise FileNotFoundError(path)
        return table
    added = fold_actions(batches)
    return added if table is None else merge_actions(table, added)
