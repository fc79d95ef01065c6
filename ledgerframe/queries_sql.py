"""More SQL over a snapshot's ``log``: ratios, grouping sets, frames, time windows, interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .limits import TS
from .queries import LOG, _sql, events, query, stream
from .streaming import windows

_sql("ratio_per_key", "SELECT user_id, round(sum(value * ledger_offset) / sum(ledger_offset), 6) AS weighted, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / sum(value), 6) AS share FROM log GROUP BY user_id")
_sql("grouping_sets", "SELECT event_type, user_id % 3 AS g, count(*) AS n, max(ledger_offset) AS last FROM log GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), ())")
_sql(
    "frames_rows_range",
    "SELECT ledger_offset, nth_value(value, 2) OVER w AS second, last_value(value) OVER w AS latest, count(*) OVER (PARTITION BY user_id ORDER BY ledger_offset RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ledger_offset ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)",
)
_sql(
    "approximate_distinct",
    "SELECT event_type, abs(approx_count_distinct(user_id, 0.02) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS close FROM log GROUP BY event_type",
    "SELECT event_type, true AS close FROM log GROUP BY event_type",
)
_sql(
    "interval_join",
    "SELECT e.ledger_offset AS error, p.ledger_offset AS purchase FROM log e JOIN log p ON e.user_id = p.user_id AND p.ledger_ts BETWEEN e.ledger_ts AND e.ledger_ts + 86400000000 WHERE e.event_type = 'error' AND p.event_type = 'purchase'",
)
_sql("as_of_latest_in_sql", "SELECT user_id, max_by(value, ledger_offset) AS v, min_by(value, ledger_offset) AS f FROM log GROUP BY user_id", "SELECT user_id, arg_max(value, ledger_offset) AS v, arg_min(value, ledger_offset) AS f FROM log GROUP BY user_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    df = windows.with_time(events(spark, sf_dir), TS)
    got = windows.grouped(df, "6 hours", keys=["event_type"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.unix_micros("window.start").alias("window_start"), "event_type", "n", "total")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts) - h * INTERVAL 6 HOUR) AS window_start, count(*) AS n FROM events, range(2) r(h) GROUP BY 1")
def sliding_windows(spark, sf_dir):
    df = windows.with_time(events(spark, sf_dir), TS)
    return windows.grouped(df, "12 hours", slide="6 hours").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("window_start"), "n")


@query(
    "WITH g AS (SELECT user_id, epoch_us(ts) AS t, sum(CASE WHEN p IS NULL OR epoch_us(ts) - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS p FROM events))"
    " SELECT user_id, min(t) AS first, max(t) + 21600000000 AS past, count(*) AS n FROM g GROUP BY user_id, s"
)
def session_windows(spark, sf_dir):
    df = windows.with_time(events(spark, sf_dir), TS)
    got = windows.sessions(df, "6 hours", keys=["user_id"]).agg(F.count("*").alias("n"))
    return got.select("user_id", F.unix_micros("session_window.start").alias("first"), F.unix_micros("session_window.end").alias("past"), "n")
