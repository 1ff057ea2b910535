"""Streaming queries over the event table, run with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    """All windows, closed or not: the stream's complete result."""
    return jobs.run_available(jobs.windowed_counts(jobs.event_stream(spark, d)), "complete")


@query("SELECT s AS window_start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return jobs.run_available(jobs.windowed_counts(jobs.event_stream(spark, d), "1 hour", "30 minutes"), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark, d):
    return jobs.run_available(jobs.deduplicated(jobs.event_stream(spark, d))).select("event_id")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_running_counts(spark, d):
    """The last state of every user, over all batches."""
    return jobs.run_available(jobs.running_counts(jobs.event_stream(spark, d)), "update", keys=["user_id"])


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS opens FROM events), n AS (SELECT user_id, ts, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM n GROUP BY user_id, no""")
def stream_sessions(spark, d):
    """All sessions, closed or not."""
    return jobs.run_available(jobs.streamed_sessions(jobs.event_stream(spark, d)), "complete")
