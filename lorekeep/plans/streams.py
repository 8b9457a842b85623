"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: How late rows may be: the span of the whole table, so that no split of it into batches makes one too late.
SPAN = "1000 days"


def _finished(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A job over all events and a closing row far behind them, in append mode: state goes as the watermark passes it, and all is told once."""
    path = f"{sf_dir}/events.parquet"
    events = spark.read.parquet(path)
    last = F.lit("2200-01-01 00:00:00").cast(events.schema["ts"].dataType)
    closing = spark.range(1).select(*(last.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields))
    return timers.finished_and_closed(spark, lambda p: job(jobs.events_stream(spark, p)), path, closing)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, sf_dir, lambda e: jobs.tumbling(e, late=SPAN))
    return out.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, sf_dir, lambda e: jobs.sliding(e, late=SPAN))
    return out.select(F.unix_millis("w.start").alias("start_ms"), "n")


def stream_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, sf_dir, lambda e: jobs.idle_sessions(e, "30 minutes", SPAN))
    return out.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.events_stream(spark, f"{sf_dir}/events.parquet")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and type: the watermark spans the whole table."""
    return jobs.finished(jobs.first_seen(_events(spark, sf_dir), ["user_id", "event_type"], "1000 days")).select("user_id", "event_type")


def stream_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, sf_dir, lambda e: timers.rate_limited(e, "user_id", 1, 6 * 3_600_000, SPAN)).where("user_id is not null").select("user_id", "ms")


def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, sf_dir, lambda e: timers.rate_limited(e, "user_id", 2, 24 * 3_600_000, SPAN)).where("user_id is not null").select("user_id", "ms")


def stream_session_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions close after twelve hours of silence, or at once on an error, which stands in for a dispose event."""
    return _finished(spark, sf_dir, lambda e: timers.session_closes(e, "user_id", "event_type = 'error'", 12 * 3_600_000, 4, SPAN)).where("user_id is not null")


def stream_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a user's store are folded into rebuilds: an hour's debounce, builds of six hours."""
    return _finished(spark, sf_dir, lambda e: timers.rebuilds(e, "user_id", 3_600_000, 6 * 3_600_000, SPAN)).where("user_id is not null").select("user_id", "ms", "n")


for _fn in (stream_tumbling, stream_sliding, stream_idle_sessions, stream_first_seen, stream_throttled, stream_rate_limited, stream_session_closes, stream_rebuilds):
    QUERIES[_fn.__name__] = _fn

ORACLE_SQL["stream_tumbling"] = "SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000 AS BIGINT) AS start_ms, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"
ORACLE_SQL["stream_sliding"] = """
SELECT (b - s) * 1800000 AS start_ms, count(*) AS n FROM (SELECT CAST(epoch_us(ts) // 1800000000 AS BIGINT) AS b FROM events) e CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1) o GROUP BY 1"""
ORACLE_SQL["stream_first_seen"] = "SELECT DISTINCT user_id, event_type FROM events"
