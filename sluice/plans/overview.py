"""Overview statistics and predicates, with events read as an action table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sluice.operators import overview as o
from sluice.operators import predicates as p
from sluice.plans.registry import Tables, plan

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit(datetime(2024, 1, 31)).cast("timestamp")


def actions(t: Tables):
    """Events in the shape of the action table."""
    minutes = F.floor("value").cast("int")
    return t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("handle-"), "event_type").alias("type"),
        F.when(F.col("value") > 100, "FAILED").when(F.col("value") > 40, "WAITING").otherwise("SUCCEEDED").alias("state"),
        F.array(F.concat(F.lit("user-"), "user_id"), F.concat(F.lit("kind-"), "event_type")).alias("tags"),
        F.array(F.struct(
            F.concat(F.col("event_type"), F.lit(".rules")).alias("file"), F.minute("ts").cast("bigint").alias("line"),
            F.lit(1).cast("bigint").alias("column"), F.lit("v1").alias("hash"),
        )).alias("locations"),
        F.col("ts").alias("created"),
        F.timestamp_add("MINUTE", minutes, F.col("ts")).alias("last_added"),
        F.timestamp_add("MINUTE", minutes * 2, F.col("ts")).alias("last_checked"),
        F.timestamp_add("MINUTE", minutes * 3, F.col("ts")).alias("last_state_transition"),
        F.when(F.col("value") > 20, F.col("ts")).alias("external_timestamp"),
        F.col("props").alias("info"),
    )


ACTIONS = """(SELECT CAST(event_id AS VARCHAR) AS id, 'handle-' || event_type AS type,
    CASE WHEN value > 100 THEN 'FAILED' WHEN value > 40 THEN 'WAITING' ELSE 'SUCCEEDED' END AS state,
    'user-' || user_id AS tag_user, 'kind-' || event_type AS tag_kind, event_type || '.rules' AS file, minute(ts) AS line,
    ts AS created, ts + INTERVAL 1 MINUTE * CAST(floor(value) AS INTEGER) AS last_added,
    ts + INTERVAL 2 MINUTE * CAST(floor(value) AS INTEGER) AS last_checked,
    ts + INTERVAL 3 MINUTE * CAST(floor(value) AS INTEGER) AS last_state_transition,
    CASE WHEN value > 20 THEN ts END AS external_timestamp, props AS info FROM events)"""


@plan("property_summary", f"""
    SELECT 'state' AS property, state AS value, count(*) AS total FROM {ACTIONS} GROUP BY 2
    UNION ALL SELECT 'tag', tag_user, count(*) FROM {ACTIONS} GROUP BY 2
    UNION ALL SELECT 'tag', tag_kind, count(*) FROM {ACTIONS} GROUP BY 2
""")
def property_summary(t: Tables):
    return o.property_summary(actions(t), "id", {"state": "state", "tag": "tags"})


@plan("crosstab_counts", f"""
    WITH t AS (SELECT state, tag_user AS tag FROM {ACTIONS} UNION ALL SELECT state, tag_kind FROM {ACTIONS})
    SELECT tag AS row_value, state AS column_value, count(*) AS n FROM t GROUP BY 1, 2
""")
def crosstab_counts(t: Tables):
    # far more tags than a screen would hold
    return o.crosstab_counts(actions(t), "state", "tags")


@plan("crosstab_display", f"""
    SELECT type AS row_value, state AS column_value, count(*) AS n FROM {ACTIONS} GROUP BY 1, 2
""")
def crosstab_display(t: Tables):
    return o.crosstab_display(o.crosstab_counts(actions(t), "state", "type"))


WIDTH = """(SELECT min(epoch_us(created) // 1000) AS lo0, min(epoch_us(last_added) // 1000) AS lo1, max(epoch_us(created) // 1000) AS hi0,
    max(epoch_us(last_added) // 1000) AS hi1 FROM a)"""
FRAME = f"""f AS (SELECT least(lo0, lo1) AS lo, greatest(hi0, hi1) AS hi, (greatest(hi0, hi1) - least(lo0, lo1)) // 100 AS even FROM {WIDTH}),
    g AS (SELECT lo, hi, greatest(even, 60000) AS width, CASE WHEN even < 60000 THEN (hi - lo) // 60000 + 1 ELSE 100 END AS n FROM f)"""


GRID = """grid AS (SELECT member, bucket, lo + bucket * width AS start_ms,
        CASE WHEN bucket = n - 1 THEN greatest(hi, lo + (bucket + 1) * width) ELSE lo + (bucket + 1) * width END AS end_ms
        FROM (SELECT g.*, unnest(range(0, n)) AS bucket FROM g) CROSS JOIN (VALUES ('created'), ('added')) AS m(member))"""


@plan("histogram", f"""
    WITH a AS (SELECT * FROM {ACTIONS}), {FRAME}, {GRID},
    times AS (SELECT 'created' AS member, epoch_us(created) // 1000 AS moment FROM a UNION ALL SELECT 'added', epoch_us(last_added) // 1000 FROM a),
    counted AS (SELECT member, least((moment - lo) // width, n - 1) AS bucket, count(*) AS n FROM times, g GROUP BY 1, 2)
    SELECT member, bucket, start_ms, end_ms, coalesce(c.n, 0) AS n FROM grid LEFT JOIN counted c USING (member, bucket)
""")
def histogram(t: Tables):
    return o.histogram(actions(t), {"created": "created", "added": "last_added"})


@plan("histogram_sparse", f"""
    WITH a0 AS (SELECT * FROM {ACTIONS}),
    a AS (SELECT * REPLACE (CAST(date_trunc('week', created) AS TIMESTAMP) AS created, CAST(date_trunc('week', last_added) AS TIMESTAMP) AS last_added) FROM a0), {FRAME}, {GRID},
    times AS (SELECT 'created' AS member, epoch_us(created) // 1000 AS moment FROM a UNION ALL SELECT 'added', epoch_us(last_added) // 1000 FROM a),
    counted AS (SELECT member, least((moment - lo) // width, n - 1) AS bucket, count(*) AS n FROM times, g GROUP BY 1, 2)
    SELECT member, bucket, start_ms, end_ms, coalesce(c.n, 0) AS n FROM grid LEFT JOIN counted c USING (member, bucket)
""")
def histogram_sparse(t: Tables):
    # all times moved to the start of their week, so that buckets between stay empty
    moved = {name: F.date_trunc("week", name) for name in ("created", "last_added")}
    return o.histogram(actions(t).withColumns(moved), {"created": "created", "added": "last_added"})


@plan("histogram_by_property", f"""
    WITH a AS (SELECT * FROM {ACTIONS}), {FRAME}, {GRID},
    times AS (SELECT state, 'created' AS member, epoch_us(created) // 1000 AS moment FROM a UNION ALL SELECT state, 'added', epoch_us(last_added) // 1000 FROM a),
    counted AS (SELECT member, state, least((moment - lo) // width, n - 1) AS bucket, count(*) AS n FROM times, g GROUP BY 1, 2, 3)
    SELECT member, s.state AS value, bucket, start_ms, end_ms, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT state FROM a) s CROSS JOIN grid LEFT JOIN counted c USING (member, bucket, state)
""")
def histogram_by_property(t: Tables):
    return o.histogram_by_property(actions(t), {"created": "created", "added": "last_added"}, "state")


@plan("oldest_by_state_type", f"SELECT state, type, max(last_state_transition) AS last_transition FROM {ACTIONS} GROUP BY 1, 2")
def oldest_by_state_type(t: Tables):
    return o.latest_transitions(actions(t), "state", "type", "last_state_transition")


@plan("action_sort", f"SELECT id, state, coalesce(epoch_us(external_timestamp) // 1000, -1) AS moment FROM {ACTIONS} ORDER BY external_timestamp DESC NULLS LAST, id")
def action_sort(t: Tables):
    ordered = o.action_sort(actions(t), "id", "external_timestamp")
    return ordered.select("id", "state", F.coalesce(F.unix_millis("external_timestamp"), F.lit(-1)).alias("moment"))


@plan("action_page", f"SELECT id, state, coalesce(epoch_us(external_timestamp) // 1000, -1) AS moment FROM {ACTIONS} ORDER BY external_timestamp DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def action_page(t: Tables):
    page = o.action_page(actions(t), "id", "external_timestamp", skip=100, limit=50)
    return page.select("id", "state", F.coalesce(F.unix_millis("external_timestamp"), F.lit(-1)).alias("moment"))


@plan("tag_list", f"""
    SELECT tag_user AS tag FROM {ACTIONS} WHERE state = 'FAILED' UNION SELECT tag_kind FROM {ACTIONS} WHERE state = 'FAILED'
""")
def tag_list(t: Tables):
    return o.tag_list(actions(t), "tags", p.has_status(["FAILED"]))


@plan("count_matching", f"SELECT count(*) AS n FROM {ACTIONS} WHERE state = 'WAITING' AND tag_kind = 'kind-click'")
def count_matching(t: Tables):
    return o.count_matching(actions(t), p.both(p.has_status(["WAITING"]), p.has_tag(["kind-click"])))


@plan("drain_purge", f"""
    SELECT CASE WHEN state = 'FAILED' AND line < 30 THEN 'taken' ELSE 'kept' END AS stream, id FROM {ACTIONS}
""")
def drain_purge(t: Tables):
    few = p.both(p.has_status(["FAILED"]), F.col("locations")[0]["line"] < 30)
    taken, kept = o.drain(actions(t), few)
    return taken.select(F.lit("taken").alias("stream"), "id").unionByName(kept.select(F.lit("kept").alias("stream"), "id"))


# ---------------------------------------------------------------- predicates

START, END = datetime(2024, 1, 8), datetime(2024, 1, 20, 12)
DAY_MS = 86_400_000
SQL_START, SQL_END = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"


def predicate(name: str, test, sql: str) -> None:
    @plan(name, f"SELECT id, state FROM {ACTIONS} WHERE {sql}")
    def run(t: Tables):
        return actions(t).filter(test()).select("id", "state")


def _moment(at: datetime):
    return F.lit(at).cast("timestamp")


for _kind, _column in p.TIMES.items():
    predicate(
        f"f_{_kind}", lambda kind=_kind: p.between(kind, _moment(START), _moment(END)),
        f"{_column} BETWEEN {SQL_START} AND {SQL_END}",
    )
    predicate(
        f"f_{_kind}ago", lambda kind=_kind: p.ago(kind, 7 * DAY_MS, now()), f"{_column} >= {NOW} - INTERVAL 7 DAY"
    )


@plan("f_id", f"SELECT id, state FROM {ACTIONS} WHERE id IN ('1', '17', '256', '4000')")
def f_id(t: Tables):
    return actions(t).filter(p.has_id(["1", "17", "256", "4000"])).select("id", "state")


predicate("f_type", lambda: p.has_type(["handle-click", "handle-view"]), "type IN ('handle-click', 'handle-view')")
predicate("f_status", lambda: p.has_status(["FAILED", "WAITING"]), "state IN ('FAILED', 'WAITING')")
predicate("f_sourcefile", lambda: p.from_file(["error.rules", "view.rules"]), "file IN ('error.rules', 'view.rules')")
predicate(
    "f_sourcelocation",
    lambda: p.from_origin([p.Origin("error.rules", 10), p.Origin("view.rules", 5, 1, "v1"), p.Origin("click.rules", 5, 2)]),
    "(file = 'error.rules' AND line = 10) OR (file = 'view.rules' AND line = 5)",
)
predicate("f_tag", lambda: p.has_tag(["user-3", "kind-signup"]), "tag_user = 'user-3' OR tag_kind = 'kind-signup'")
predicate(
    "f_tag_regex", lambda: p.tag_matches("r-1[0-9]$"),
    "regexp_matches(tag_user, 'r-1[0-9]$') OR regexp_matches(tag_kind, 'r-1[0-9]$')",
)
predicate("f_text", lambda: p.text(["info", "type"], "K\": 4"), "contains(lower(info), 'k\": 4') OR contains(lower(type), 'k\": 4')")
predicate("f_regex", lambda: p.regex(["info"], "k\": [1-3]}"), "regexp_matches(info, 'k\": [1-3]}')")


@plan("f_orphaned", f"SELECT id, state FROM {ACTIONS} WHERE NOT (file IN ('click.rules', 'error.rules') AND line < 40)")
def f_orphaned(t: Tables):
    origins = actions(t).select(F.explode("locations").alias("o")).select("o.*").distinct()
    live = origins.filter(F.col("file").isin("click.rules", "error.rules") & (F.col("line") < 40))
    return p.orphaned(actions(t), live).select("id", "state")


predicate(
    "f_and", lambda: p.both(p.has_status(["FAILED"]), p.has_type(["handle-view"])), "state = 'FAILED' AND type = 'handle-view'"
)
predicate(
    "f_or", lambda: p.either(p.has_status(["FAILED"]), p.has_type(["handle-view"])), "state = 'FAILED' OR type = 'handle-view'"
)
predicate("f_not", lambda: p.negated(p.has_status(["FAILED"])), "state <> 'FAILED'")


def _named():
    return {"clicks": p.has_type(["handle-click"]), "views": p.has_type(["handle-view"])}


predicate(
    "join_all_and", lambda: p.all_and(p.has_status(["WAITING"]), _named()),
    "state = 'WAITING' AND type IN ('handle-click', 'handle-view')",
)
predicate(
    "join_all_except", lambda: p.all_except(p.has_status(["WAITING"]), _named()),
    "state = 'WAITING' AND type NOT IN ('handle-click', 'handle-view')",
)


@plan("join_each_and", f"""
    SELECT 'clicks' AS name, id FROM {ACTIONS} WHERE state = 'WAITING' AND type = 'handle-click'
    UNION ALL SELECT 'views' AS name, id FROM {ACTIONS} WHERE state = 'WAITING' AND type = 'handle-view'
""")
def join_each_and(t: Tables):
    each = p.each_and(p.has_status(["WAITING"]), _named())
    frames = [actions(t).filter(test).select(F.lit(n).alias("name"), "id") for n, test in each.items()]
    return frames[0].unionByName(frames[1])


# -------------------------------------------------------------------- alerts


def alerts(t: Tables):
    """Events as alerts, one per event."""
    labels = F.map_filter(
        F.create_map(
            F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"),
            F.lit("grave"), F.when(F.col("value") > 100, F.lit("yes")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return t.events.select(
        F.col("event_id").cast("string").alias("id"), labels.alias("labels"), F.col("ts").alias("starts_at"),
        F.timestamp_add("HOUR", F.floor("value").cast("int"), F.col("ts")).alias("ends_at"),
        F.array(F.struct(
            F.concat(F.col("event_type"), F.lit(".rules")).alias("file"), F.minute("ts").cast("bigint").alias("line"),
            F.lit(1).cast("bigint").alias("column"), F.lit("v1").alias("hash"),
        )).alias("locations"),
    )


ALERTS = """(SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS usr, value > 100 AS grave,
    ts + INTERVAL 1 HOUR * CAST(floor(value) AS INTEGER) AS ends_at, minute(ts) AS line FROM events)"""


def alert_predicate(name: str, test, sql: str) -> None:
    @plan(name, f"SELECT id, epoch_us(ends_at) AS ends FROM {ALERTS} WHERE {sql}")
    def run(t: Tables):
        return alerts(t).filter(test()).select("id", F.unix_micros("ends_at").alias("ends"))


alert_predicate("alert_has", lambda: p.label_present("grave"), "grave")
alert_predicate("alert_has_regex", lambda: p.label_present(pattern="gr[a-z]v"), "grave")
alert_predicate("alert_eq", lambda: p.label_equals("kind", "error"), "kind = 'error'")
alert_predicate("alert_eq_regex", lambda: p.label_equals("user", pattern="1[0-9]"), "regexp_full_match(usr, '1[0-9]')")
alert_predicate("alert_is_live", lambda: p.is_live(now()), f"ends_at > {NOW}")
alert_predicate("alert_sourcelocation", lambda: p.from_origin([p.Origin("view.rules", 7)]), "kind = 'view' AND line = 7")
alert_predicate("alert_and", lambda: p.both(p.label_present("grave"), p.label_equals("kind", "view")), "grave AND kind = 'view'")
alert_predicate("alert_or", lambda: p.either(p.label_present("grave"), p.label_equals("kind", "view")), "grave OR kind = 'view'")
alert_predicate("alert_not", lambda: p.negated(p.label_present("grave")), "NOT grave")
