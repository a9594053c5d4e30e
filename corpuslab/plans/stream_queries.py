"""Batch runs of the streaming additions, so SQL can hold them."""

from __future__ import annotations

from corpuslab.registry import query
from corpuslab.sources import table
from corpuslab.streaming import latency


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS most, round(count(*) FILTER (WHERE value > 16) / count(*), 9) AS over FROM events GROUP BY 1, 2""")
def stream_latency_windows(spark, sf):
    return latency.latency_windows(table(spark, sf, "events"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def stream_latency_sessions(spark, sf):
    return latency.latency_sessions(table(spark, sf, "events"))
