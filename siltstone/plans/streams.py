"""Streaming queries, run over the stored events, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.streaming import runs


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    events = runs.event_stream(s, d).select("event_id", "event_type", "ts")
    return runs.run_to_table(runs.distinct_events(events, ["event_id"]).select("event_id", "event_type"), "append")


def stream_day_counts(s: SparkSession, d: str) -> DataFrame:
    out = runs.run_to_table(runs.day_counts(runs.event_stream(s, d)), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    out = runs.run_to_table(runs.session_counts(runs.event_stream(s, d), "user_id", "6 hours"), "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def stream_state_machine(s: SparkSession, d: str) -> DataFrame:
    return runs.run_to_table(runs.run_states(runs.event_stream(s, d).select("user_id", "event_type", "ts")), "update", ["user_id"])


QUERIES = {
    "stream_dedup": (stream_dedup, "SELECT DISTINCT event_id, event_type FROM events"),
    "stream_day_counts": (stream_day_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000 THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k"),
    "stream_state_machine": (stream_state_machine, "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS state, count(*) AS n_events FROM events GROUP BY user_id"),
}
