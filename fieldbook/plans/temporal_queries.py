"""Queries in time over the events, and subtotals of the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.operators import temporal as T
from fieldbook.plans.bindings import CASES, cases
from fieldbook.plans.registry import query
from fieldbook.session import table


@query(
    """SELECT p.event_id, p.user_id, v.event_id AS view_id, CAST(round(v.value * 100) AS BIGINT) AS view_cents
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_join(spark, d):
    """Each purchase with the user's last view before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return T.asof_join(bought, e.where("event_type = 'view'"), ["user_id"], "ts", {"event_id": "view_id", "cents": "view_cents"}).drop("ts")


@query(
    """WITH p AS (SELECT p.event_id, p.user_id, v.event_id AS view_id, date_diff('microsecond', v.ts, p.ts) AS age
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts)
SELECT event_id, user_id, CASE WHEN age <= 86400000000 THEN view_id END AS view_id FROM p"""
)
def asof_within_day(spark, d):
    """The same, but a view older than a day doesn't count."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").drop("event_type")
    return T.asof_join(bought, e.where("event_type = 'view'"), ["user_id"], "ts", {"event_id": "view_id"}, F.expr("INTERVAL 1 DAY")).drop("ts")


def _spans(e, kind, hours, name):
    rows = e.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "user_id", F.col("ts").alias("since"))
    return rows.withColumn("until", F.timestamp_add("HOUR", (F.col(name) % hours + 1).cast("int"), F.col("since")))


_OVERLAPS = """WITH a AS (SELECT event_id AS error_id, user_id, ts AS since, ts + to_hours(CAST(event_id % 5 + 1 AS INT)) AS until FROM events WHERE event_type = 'error'),
b AS (SELECT event_id AS view_id, user_id, ts AS since, ts + to_hours(CAST(event_id % 97 + 1 AS INT)) AS until FROM events WHERE event_type = 'view')"""


@query(f"{_OVERLAPS} SELECT a.error_id, b.view_id, a.user_id FROM a JOIN b ON a.user_id = b.user_id AND a.since < b.until AND b.since < a.until")
def interval_join(spark, d):
    """Spells of errors (1 to 5 hours) that overlap a spell of views (1 to 97 hours) of the same user."""
    e = table(spark, d, "events")
    ends = ("since", "until")
    return T.interval_join(_spans(e, "error", 5, "error_id"), _spans(e, "view", 97, "view_id"), ["user_id"], ends, ends, {"view_id": "view_id"}).drop(*ends)


@query(f"{_OVERLAPS} SELECT a.error_id, count(*) AS n FROM a JOIN b ON a.since < b.until AND b.since < a.until GROUP BY a.error_id")
def interval_load(spark, d):
    """How many spells of views, of whoever, each spell of errors overlaps: a join without any equality, counted without its pairs."""
    e = table(spark, d, "events")
    ends = ("since", "until")
    return T.interval_load(_spans(e, "error", 5, "error_id"), _spans(e, "view", 97, "view_id"), ["error_id"], [], ends, ends)


_SUMS = "CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) AS cents"


@query(f"WITH {CASES} SELECT parent, category, year, {_SUMS}, CAST(GROUPING_ID(parent, category, year) AS BIGINT) AS level FROM cases GROUP BY CUBE (parent, category, year)")
def cube_subtotals(spark, d):
    c = cases(spark, d).withColumn("cents", (F.col("amount") * 100).cast("bigint"))
    return T.subtotals(c, ["parent", "category", "year"], ["cents"])


@query(
    f"""WITH {CASES} SELECT parent, grp, status, {_SUMS}, CAST(GROUPING_ID(parent, grp, status) AS BIGINT) AS level FROM cases
GROUP BY GROUPING SETS ((parent, grp, status), (parent, grp), (parent, status), (parent), ())"""
)
def grouping_sets(spark, d):
    """A report with subtotals of places and of status, without those that nobody asks for."""
    c = cases(spark, d).withColumn("cents", (F.col("amount") * 100).cast("bigint"))
    return T.subtotals(c, ["parent", "grp", "status"], ["cents"], [["parent", "grp", "status"], ["parent", "grp"], ["parent", "status"], ["parent"], []])
