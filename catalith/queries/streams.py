"""Stateful operators: anchored rate windows, circuit breaker, windowed counts from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import raw, view
from ..streaming import limits
from ..streaming.jobs import run_available


_WINDOWS = """WITH RECURSIVE w AS (SELECT source, min(ts) AS start FROM requests GROUP BY source
  UNION ALL SELECT w.source, (SELECT min(r.ts) FROM requests r WHERE r.source = w.source AND r.ts >= w.start + INTERVAL 6 HOUR) FROM w WHERE w.start IS NOT NULL),
p AS (SELECT r.source, r.event_id, w.start AS window_start, row_number() OVER (PARTITION BY r.source, w.start ORDER BY r.ts, r.event_id) AS place
  FROM requests r ASOF JOIN (SELECT * FROM w WHERE start IS NOT NULL) w ON r.source = w.source AND r.ts >= w.start)"""


@query("rate_limit_anchored", f"{_WINDOWS} SELECT source, event_id, window_start, place AS n, place <= 3 AS allowed FROM p")
def rate_limit_anchored(spark, d):
    """Every request's window of six hours, its number there and whether it passes; denied requests count."""
    return limits.anchored_windows(view(spark, d, "requests"), 6 * 3600, limit=3).drop("ts")


@query("rate_limit_denied", f"{_WINDOWS} SELECT source, event_id, least(place, 4) AS n FROM p WHERE place > 3")
def rate_limit_denied(spark, d):
    """Requests over three in a window, where denied requests do not count."""
    return limits.anchored_windows(view(spark, d, "requests"), 6 * 3600, limit=3, count_denied=False).filter("not allowed").select("source", "event_id", "n")


@query(
    "circuit_breaker",
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS k FROM requests),
l AS (SELECT event_id, ts, max(CASE WHEN status IN ('blocked', 'ok', 'slow') THEN k END) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j, source FROM m)
SELECT l.event_id, coalesce(m.status = 'blocked' AND l.ts < m.ts + INTERVAL 30 MINUTE, FALSE) AS skipped FROM l LEFT JOIN m ON m.source = l.source AND m.k = l.j""",
)
def circuit_breaker(spark, d):
    return limits.breaker_open(view(spark, d, "requests")).select("event_id", "skipped")


@query("hourly_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, endpoint, count(*) AS n FROM requests GROUP BY ALL")
def hourly_counts(spark, d):
    return limits.hourly_counts(view(spark, d, "requests"))


def _event_stream(spark, d):
    """The events' file as a stream."""
    schema = raw(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_event_totals", "SELECT event_type AS endpoint, count(*) AS n FROM events GROUP BY event_type")
def stream_event_totals(spark, d):
    """Totals per endpoint from a stream over the events' file, run until nothing is left."""
    events = _event_stream(spark, d).select("event_id", "ts", F.col("event_type").alias("endpoint"))
    return run_available(events).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_log",
    """WITH RECURSIVE e AS (SELECT concat(CAST(source AS VARCHAR), ':', endpoint) AS key, event_id, ts FROM requests),
w AS (SELECT key, min(ts) AS ts FROM e GROUP BY key
  UNION ALL SELECT w.key, (SELECT min(e.ts) FROM e WHERE e.key = w.key AND e.ts >= w.ts + INTERVAL 48 HOUR) FROM w WHERE w.ts IS NOT NULL)
SELECT key, min(event_id) AS event_id, ts, ts + INTERVAL 48 HOUR AS expires FROM w JOIN e USING (key, ts) GROUP BY key, ts""",
)
def event_log(spark, d):
    """The first event of each source and endpoint, and again once it has run out, from a replayed stream."""
    events = _event_stream(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts")
    return run_available(limits.event_log(events))
