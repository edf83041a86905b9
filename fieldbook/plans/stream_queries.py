"""Queries over the events as a stream of files, by event time, and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions.tables import register_tables
from fieldbook.operators.temporal import whole_number
from fieldbook.plans.registry import query
from fieldbook.plans.source_queries import _new
from fieldbook.session import table
from fieldbook.streaming import incremental as I
from fieldbook.streaming import windows as W


def _files(spark, d, order):
    """The events in a file for each third of their time, put down in the given order."""
    path = f"{_new(spark, 'stream')}/in"
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    us = whole_number(e, "ts")
    first, last = e.agg(F.min(us), F.max(us)).first()
    third = F.floor((us - (first or 0)) * 3 / ((last or 0) - (first or 0) + 1))
    for i in order:
        e.where(third == i).coalesce(1).write.mode("append").parquet(path)
    return path


def _micros(c):
    return f"date_diff('microsecond', TIMESTAMP '1970-01-01', {c})"


@query(f"SELECT event_type, {_micros('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} AS started, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Days by event time, while the files come last third first; a second run finds nothing new."""
    path = _files(spark, d, (2, 0, 1))
    state = path[:-3] + "/state"
    W.event_windows(spark, path, "ts", ["event_type"], ["cents"], state, width="1 day")
    got = W.event_windows(spark, path, "ts", ["event_type"], ["cents"], state, width="1 day")
    return got.select("event_type", whole_number(got, "window_start").alias("started"), "n", "cents")


_GAPS = f"""WITH e AS (SELECT user_id, {_micros('ts')} AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
o AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us) AS s FROM o)"""


@query(f"{_GAPS} SELECT user_id, min(us) AS started, max(us) + 21600000000 AS ended, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY user_id, s")
def event_sessions(spark, d):
    """Sessions of users that end after six hours without an event, while the files come in any order."""
    path = _files(spark, d, (1, 2, 0))
    got = W.event_windows(spark, path, "ts", ["user_id"], ["cents"], path[:-3] + "/state", gap="6 hours")
    return got.select("user_id", whole_number(got, "window_start").alias("started"), whole_number(got, "window_end").alias("ended"), "n", "cents")


@query(
    f"""WITH e AS (SELECT event_type, {_micros('ts')} AS us FROM events), m AS (SELECT max(us) - 3600000000 AS mark FROM e),
c AS (SELECT event_type, us // 21600000000 AS period, count(*) AS n FROM e GROUP BY ALL),
d AS (SELECT f.event_type, f.period, coalesce(c.n, 0) AS n FROM (SELECT event_type, unnest(range(min(period), max(period) + 1)) AS period FROM c GROUP BY event_type) f LEFT JOIN c ON c.event_type = f.event_type AND c.period = f.period),
w AS (SELECT *, sum(n) OVER h AS before, count(*) OVER h AS k FROM d WINDOW h AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT event_type, CAST(period AS BIGINT) AS period, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM w, m WHERE k = 4 AND n >= 3 AND n * 4 > 1.25 * before AND (period + 1) * 21600000000 <= (mark // 1000) * 1000"""
)
def spike_stream(spark, d):
    """Quarters of a day with over 1.25 times the mean of the four before, told once by keyed state with timers; a second run tells nothing twice."""
    path = _files(spark, d, (0, 1, 2))
    state = path[:-3] + "/state"
    W.spike_stream(spark, path, "event_type", "ts", state, 21600, 1.25, 3)
    return W.spike_stream(spark, path, "event_type", "ts", state, 21600, 1.25, 3)


@query("SELECT event_type, count(*) AS n, TRUE AS distinct_near, TRUE AS median_near FROM events GROUP BY event_type")
def incremental_sketches(spark, d):
    """Merged sketches of users and amounts, held against the exact figures within their stated errors."""
    path = _files(spark, d, (0, 1, 2))
    got = I.incremental_sketches(spark, path, ["event_type"], "user_id", "cents", [0.5], path[:-3] + "/state")
    e = table(spark, d, "events").select("event_type", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    found = e.join(F.broadcast(got), "event_type")  # a row for each type
    below, upto = F.avg((F.col("cents") < F.col("quantiles")[0]).cast("int")), F.avg((F.col("cents") <= F.col("quantiles")[0]).cast("int"))
    checked = found.groupBy("event_type", "n", "n_distinct").agg(F.count_distinct("user_id").alias("users"), below.alias("below"), upto.alias("upto"))
    near = F.abs(F.col("n_distinct") - F.col("users")) <= 0.05 * F.col("users")
    return checked.select("event_type", "n", near.alias("distinct_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


@query(f"{_GAPS} SELECT user_id AS key, min(us) AS started, max(us) AS ended, count(*) AS n FROM s GROUP BY user_id, s")
def table_function(spark, d):
    """Sessions by a table function of ours, called from SQL."""
    register_tables(spark)
    e = table(spark, d, "events")
    return spark.sql("SELECT * FROM sessions(TABLE({e}), 21600000000)", e=e.select(F.col("user_id").alias("key"), whole_number(e, "ts").alias("at")))
