"""Windowed queries over the events table: the batch side of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.sources.tables import read
from flowspark.streaming.scoring import activity, sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return activity(e, "event_type", "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return activity(e, "event_type", "ts", window="2 days", slide="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return sessions(e, "user_id", "ts").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES |= {"events_tumbling": events_tumbling, "events_sliding": events_sliding, "events_sessions": events_sessions}
SQL |= {
    "events_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_sliding": "SELECT strftime(date_trunc('day', ts)::TIMESTAMP - to_days(k::INT), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL",
    "events_sessions": "WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k",
}
