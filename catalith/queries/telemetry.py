"""Telemetry: health, alerts, logs, caches, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as M
from ..registry import query
from ..sources.tables import view

_DAY = "day AS (SELECT * FROM requests WHERE ts >= (SELECT max(ts) FROM requests) - INTERVAL 24 HOUR)"
_HEALTH = f"""{_DAY}, health AS (SELECT source, count(*) AS requests, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'slow') AS slow,
  count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'no-results') AS no_results, count(*) FILTER (WHERE status = 'error') AS error,
  floor(100 * count(*) FILTER (WHERE status IN ('ok', 'slow')) / count(*) * 10 + 0.5) / 10 AS success_rate, CAST(floor(sum(latency) / count(*) + 0.5) AS BIGINT) AS average_ms,
  arg_max(status, (ts, event_id)) AS last_status FROM day GROUP BY source)"""


def _day(spark, d):
    events = view(spark, d, "requests")
    return M.within_day(events, events.agg(F.max("ts").alias("as_of"))).drop("as_of")


@query("source_health_24h", f"WITH {_HEALTH} SELECT source, requests, ok, slow, blocked, no_results, error, success_rate, average_ms, last_status FROM health")
def source_health_24h(spark, d):
    return M.source_health(_day(spark, d))


@query("endpoint_health_p95", f"WITH {_DAY} SELECT endpoint, count(*) AS requests, quantile_disc(latency, 0.95) AS p95, arg_max(event_id, (ts, event_id)) AS last_event FROM day GROUP BY endpoint")
def endpoint_health_p95(spark, d):
    return M.endpoint_health(_day(spark, d))


@query(
    "last_failures",
    "SELECT source, event_id, place FROM (SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS place FROM requests WHERE status IN ('error', 'blocked')) WHERE place <= 5",
)
def last_failures(spark, d):
    return M.last_failures(view(spark, d, "requests")).select("source", "event_id", "place")


@query("last_events", "SELECT source, arg_max(event_id, (ts, event_id)) AS event_id FROM requests GROUP BY source")
def last_events(spark, d):
    return view(spark, d, "requests").groupBy("source").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "unseen_sources",
    f"""WITH {_DAY}, h AS (SELECT source, count(*) AS requests FROM day GROUP BY source)
SELECT coalesce(user_id, source) AS source, coalesce(requests, 0) AS requests FROM (SELECT DISTINCT user_id FROM users) u FULL JOIN h ON h.source = u.user_id""",
)
def unseen_sources(spark, d):
    health = _day(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("requests"))
    configured = view(spark, d, "users").select(F.col("user_id").alias("source"))
    return M.with_unseen(health, configured)


_ALERTS = f"""{_HEALTH}, alerts AS (
  SELECT source, 'blocked-now' AS rule, 'critical' AS severity FROM health WHERE last_status = 'blocked'
  UNION ALL SELECT source, 'often-blocked', 'warning' FROM health WHERE blocked >= 3
  UNION ALL SELECT source, 'errors', 'warning' FROM health WHERE error >= 3 OR last_status = 'error'
  UNION ALL SELECT source, 'empty', 'info' FROM health WHERE no_results >= 5 AND requests >= 5
  UNION ALL SELECT source, 'low-success', 'warning' FROM health WHERE success_rate < 80 AND requests >= 5)"""


@query("alert_rules", f"WITH {_ALERTS} SELECT * FROM alerts")
def alert_rules(spark, d):
    return M.alerts(M.source_health(_day(spark, d)))


@query("alert_counts", f"WITH {_ALERTS} SELECT severity, count(*) AS n FROM alerts GROUP BY severity")
def alert_counts(spark, d):
    return M.alerts(M.source_health(_day(spark, d))).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("slowest_sources", f"WITH {_HEALTH} SELECT source, average_ms FROM health ORDER BY average_ms DESC, source LIMIT 6")
def slowest_sources(spark, d):
    return M.source_health(_day(spark, d)).orderBy(F.col("average_ms").desc(), "source").limit(6).select("source", "average_ms")


@query("merged_log", "SELECT event_id, source, endpoint FROM (SELECT event_id, ts, source, NULL AS endpoint FROM requests WHERE status = 'error' UNION ALL SELECT event_id, ts, NULL, endpoint FROM requests WHERE status = 'slow') ORDER BY ts DESC, event_id DESC LIMIT 160")
def merged_log(spark, d):
    events = view(spark, d, "requests")
    return M.merged_log(events.filter("status = 'error'").select("event_id", "ts", "source"), events.filter("status = 'slow'").select("event_id", "ts", "endpoint")).select(
        "event_id", "source", "endpoint"
    )


@query(
    "merged_events",
    """WITH e AS (SELECT event_id, ts, 'kept' AS side FROM requests WHERE status IN ('ok', 'slow') UNION ALL SELECT event_id, ts, 'preferred' FROM requests WHERE status IN ('slow', 'error'))
SELECT event_id, max(side) AS side FROM e GROUP BY event_id, ts ORDER BY ts DESC, event_id DESC LIMIT 1500""",
)
def merged_events(spark, d):
    events = view(spark, d, "requests").select("event_id", "ts", "status")
    kept = events.filter("status in ('ok', 'slow')").select("event_id", "ts").withColumn("side", F.lit("kept"))
    preferred = events.filter("status in ('slow', 'error')").select("event_id", "ts").withColumn("side", F.lit("preferred"))
    return M.merge_events(kept, preferred, "event_id", 1500).select("event_id", "side")


@query(
    "cache_age_class",
    "SELECT event_id, CASE WHEN latency >= 10000 THEN 'EXPIRED' WHEN latency >= 8000 THEN 'STALE' ELSE 'FRESH' END AS state FROM requests",
)
def cache_age_class(spark, d):
    return view(spark, d, "requests").select("event_id", M.cache_state(F.col("latency"), F.lit(10000)).alias("state"))


@query(
    "cache_hit_rates",
    """SELECT endpoint, floor(100 * count(*) FILTER (WHERE latency < 5000) / greatest(count(*), 1) * 10 + 0.5) / 10 AS hit_rate, min(ts) AS oldest, max(ts) AS newest FROM requests GROUP BY endpoint""",
)
def cache_hit_rates(spark, d):
    rate = M.one_decimal(100 * F.count_if(F.col("latency") < 5000) / F.greatest(F.count(F.lit(1)), F.lit(1)))
    return view(spark, d, "requests").groupBy("endpoint").agg(rate.alias("hit_rate"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query(
    "error_kinds",
    r"""WITH m AS (SELECT event_id, concat(endpoint, ' failed: HTTP ', CAST(400 + event_id % 130 AS STRING), CASE WHEN event_id % 3 = 0 THEN ' timeout' ELSE ' fetch' END) AS message FROM requests)
SELECT event_id, TRY_CAST(nullif(regexp_extract(message, '\b([45]\d\d)\b', 1), '') AS INT) AS http,
  CASE WHEN TRY_CAST(nullif(regexp_extract(message, '\b([45]\d\d)\b', 1), '') AS INT) IN (403, 429) THEN 'BLOCKED' WHEN lower(message) LIKE '%timeout%' THEN 'TIMEOUT' ELSE 'NETWORK' END AS kind FROM m""",
)
def error_kinds(spark, d):
    tail = F.when(F.col("event_id") % 3 == 0, " timeout").otherwise(" fetch")
    message = F.concat("endpoint", F.lit(" failed: HTTP "), (400 + F.col("event_id") % 130).cast("string"), tail)
    return view(spark, d, "requests").withColumn("m", message).select("event_id", M.http_status(F.col("m")).alias("http"), M.error_kind(F.col("m")).alias("kind"))
