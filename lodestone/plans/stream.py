"""Queries that run a stream over the event table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources import shared
from lodestone.streaming import events as E


def _drained(spark, sf_dir, make, mode="complete"):
    return E.drained(make(E.event_stream(spark, sf_dir)), f"{shared.shared_folder(spark)}/stream-{shared.unique()}", mode)


def tumbling(spark, sf_dir):
    return _drained(spark, sf_dir, E.tumbling)


def sliding(spark, sf_dir):
    return _drained(spark, sf_dir, E.sliding)


def sessions(spark, sf_dir):
    return _drained(spark, sf_dir, E.sessions)


def deduplicated(spark, sf_dir):
    return _drained(spark, sf_dir, E.deduplicated, "append").groupBy("event_type").agg(F.count("*").alias("n"))


def thread_state(spark, sf_dir):
    return _drained(spark, sf_dir, E.thread_state, "update").groupBy("user_id").agg(F.max("turn_count").alias("turn_count"), F.max_by("last_type", "turn_count").alias("last_type"))


QUERIES = {
    "st01_tumbling": (tumbling, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "st02_sliding": (
        sliding,
        "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM events UNION ALL SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR FROM events) GROUP BY 1",
    ),
    "st03_sessions": (
        sessions,
        """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new_ FROM events)) GROUP BY user_id, s""",
    ),
    "st04_deduplicated": (deduplicated, "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1"),
    "st05_thread_state": (thread_state, "SELECT user_id, count(*) AS turn_count, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM events GROUP BY 1"),
}
