"""Health of sources and endpoints, alert rules, and the merged log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.price import half_up


def within_day(events: DataFrame, as_of: DataFrame, hours: int = 24) -> DataFrame:
    """Events of the last hours before ``as_of`` (one row), with as_of."""
    return events.join(F.broadcast(as_of)).filter(F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def one_decimal(value: Column) -> Column:
    """Rounded half up to one decimal."""
    return F.floor(value * 10 + 0.5) / 10


def _health(events: DataFrame, key: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "status"), F.struct("ts", "event_id"))
    good = F.count_if(F.col("status").isin("ok", "slow"))
    total = F.count(F.lit(1))
    return events.groupBy(key).agg(
        total.alias("requests"),
        *(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("ok", "slow", "blocked", "no-results", "error")),
        one_decimal(100 * good / total).alias("success_rate"),
        half_up(F.sum("latency") / total).alias("average_ms"),
        last.alias("_last"),
    )


def source_health(events: DataFrame, key: str = "source") -> DataFrame:
    """Counts by status, success rate, mean latency and last status per source."""
    found = _health(events, key)
    return found.select(*[c for c in found.columns if c != "_last"], F.col("_last.status").alias("last_status"))


def endpoint_health(events: DataFrame) -> DataFrame:
    """Requests, nearest-rank 95th percentile of latency and last event per endpoint."""
    return events.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"),
    )


def last_failures(events: DataFrame, key: str = "source", n: int = 5) -> DataFrame:
    """The newest failures of each source, with their place."""
    failed = events.filter(F.col("status").isin("error", "blocked"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return failed.withColumn("place", place.cast("long")).filter(F.col("place") <= n)


def with_unseen(health: DataFrame, configured: DataFrame, key: str = "source") -> DataFrame:
    """All configured sources, those without events with zeros."""
    return configured.select(key).join(health, key, "full").na.fill(0)


def alerts(health: DataFrame, key: str = "source") -> DataFrame:
    """One row per rule that a source breaks: (key, rule, severity)."""
    rules = [
        ("blocked-now", "critical", F.col("last_status") == "blocked"),
        ("often-blocked", "warning", F.col("blocked") >= C.BLOCKED_ALERT),
        ("errors", "warning", (F.col("error") >= C.ERROR_ALERT) | (F.col("last_status") == "error")),
        ("empty", "info", (F.col("no_results") >= C.EMPTY_ALERT) & (F.col("requests") >= C.MIN_REQUESTS)),
        ("low-success", "warning", (F.col("success_rate") < C.SUCCESS_ALERT) & (F.col("requests") >= C.MIN_REQUESTS)),
    ]
    broken = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"))) for name, level, test in rules)))
    return health.select(key, F.explode(broken).alias("a")).select(key, "a.rule", "a.severity")


def merged_log(one: DataFrame, other: DataFrame, n: int = C.LOG_ROWS) -> DataFrame:
    """Two event logs as one feed, newest first."""
    feed = one.unionByName(other, allowMissingColumns=True)
    return feed.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def merge_events(kept: DataFrame, preferred: DataFrame, key: str, n: int) -> DataFrame:
    """Events of both sides once each, the preferred side's row winning; the last n by time."""
    both = kept.withColumn("_p", F.lit(1)).unionByName(preferred.withColumn("_p", F.lit(0)))
    one = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter("_r = 1").drop("_r", "_p")
    return one.orderBy(F.col("ts").desc(), F.col(key).desc()).limit(n)


def http_status(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"\b([45]\d\d)\b", 1), F.lit("")).cast("int")


def error_kind(message: Column) -> Column:
    """blocked for 403 and 429, else error; ``TIMEOUT``, ``NETWORK``, ``PARSE`` or ``UNKNOWN`` from the words."""
    low = F.lower(message)
    return (
        F.when(http_status(message).isin(403, 429), "BLOCKED")
        .when(low.rlike("timeout|abort"), "TIMEOUT")
        .when(low.rlike("fetch|network|econn"), "NETWORK")
        .when(low.rlike("json|parse|unexpected token"), "PARSE")
        .otherwise("UNKNOWN")
    )


def cache_state(age: Column, ttl: Column) -> Column:
    """FRESH for the first 80 percent of the time to live, STALE for the rest, then EXPIRED."""
    return F.when(age >= ttl, "EXPIRED").when(age >= ttl * C.FRESH_SHARE, "STALE").otherwise("FRESH")
