"""Anchored windows, the breaker and the event log against loops over time."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from catalith.streaming import jobs, limits
from catalith.streaming.jobs import run_available

START = dt.datetime(2026, 1, 1)


def requests(seed, n, sources, seconds):
    """Dense and sparse sources, ties, times before 1970, one source with most of the rows."""
    r = random.Random(seed)
    rows = [(k, r.choice(sources), START + dt.timedelta(seconds=r.randint(0, seconds)), r.choice(["ok", "blocked", "slow", "error"])) for k in range(n)]
    rows += [(n + k, 0, START + dt.timedelta(seconds=7 * k), "blocked" if k % 5 else "ok") for k in range(400)]  # never idle for a window
    rows += [(2 * n + k, 99, dt.datetime(1969, 12, 31, 23, 59) + dt.timedelta(seconds=20 * (k // 2)), "blocked") for k in range(20)]
    return rows


def plain_windows(rows, seconds, limit, count_denied):
    state, out = {}, set()
    for event_id, source, ts, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        start, n = state.get(source, (None, 0))
        if start is None or ts >= start + dt.timedelta(seconds=seconds):
            start, n = ts, 0
        allowed = n + 1 <= limit
        out.add((source, event_id, ts, start, n + 1, allowed))
        state[source] = (start, n + 1 if allowed or count_denied else n)
    return out


@pytest.mark.parametrize("streamed, seconds, count_denied", [(0, 60, True), (100, 60, False), (0, 3600, True), (0, 1, True), (10**6, 60, True), (10**6, 86_400, False)])
def test_anchored_windows_against_a_loop(spark, monkeypatch, streamed, seconds, count_denied):
    monkeypatch.setattr(limits, "STREAMED", streamed)  # above it a source's windows are found by doubling
    rows = requests(3, 500, [0, 0, 0, 1, 2, 3], 20_000)
    found = limits.anchored_windows(spark.createDataFrame(rows, "event_id long, source long, ts timestamp, status string"), seconds, 4, count_denied)
    assert set(map(tuple, found.collect())) == plain_windows(rows, seconds, 4, count_denied) and found.count() == len(rows)


def test_no_requests(spark):
    none = spark.createDataFrame([], "event_id long, source long, ts timestamp, status string")
    assert limits.anchored_windows(none, 60).count() == 0 and limits.breaker_open(none).count() == 0


@pytest.mark.parametrize("minutes", [1, 30])
def test_breaker_against_a_loop(spark, minutes):
    rows = requests(4, 600, [0, 1, 2], 40_000)
    found = limits.breaker_open(spark.createDataFrame(rows, "event_id long, source long, ts timestamp, status string"), minutes)
    last, want = {}, {}
    for event_id, source, ts, status in sorted(rows, key=lambda x: (x[2], x[0])):
        held = last.get(source)
        want[event_id] = held is not None and held[1] == "blocked" and ts < held[0] + dt.timedelta(minutes=minutes)
        if status in ("ok", "blocked", "slow"):
            last[source] = (ts, status)
    assert {r["event_id"]: r["skipped"] for r in found.collect()} == want and any(want.values())


def plain_log(rows, hours):
    until, kept = {}, set()
    for key, event_id, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        if key not in until or ts >= until[key]:
            until[key] = ts + dt.timedelta(hours=hours)
            kept.add((key, event_id, ts, until[key]))
    return kept


def test_event_log_against_a_loop(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"k{r.randint(0, 20)}", k, START + dt.timedelta(minutes=r.randint(0, 12_000))) for k in range(400)]
    rows += [(k, e, t) for k, e, t in rows[:40]]  # repeats
    table = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    found = run_available(limits.event_log(stream, hours=48), str(tmp_path / "log"))
    assert set(map(tuple, found.collect())) == plain_log(rows, 48) and found.count() < len(rows) / 2


def test_event_log_over_several_batches(spark, tmp_path):
    """State lasts from batch to batch, late repeats within the time are dropped, and expired keys are taken anew."""
    days = [[("a", 1, 0), ("b", 2, 1)], [("a", 3, 30), ("c", 4, 26)], [("a", 5, 50), ("a", 6, 49), ("b", 7, 40)], [("b", 8, 200), ("a", 9, 60)]]
    for k, day in enumerate(days):
        rows = [(key, e, START + dt.timedelta(hours=h)) for key, e, h in day]
        spark.createDataFrame(rows, "key string, event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("key string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    found = run_available(limits.event_log(stream, hours=48, late="96 hours"), str(tmp_path / "log"))
    assert sorted(r["event_id"] for r in found.select(F.col("event_id")).collect()) == [1, 2, 4, 6, 8]


@pytest.mark.parametrize("slots", [1, 16])
def test_event_log_asks_the_store_once_per_slot(spark, tmp_path, slots):
    """However many keys a batch has, its state is one value and one timer per slot; keys of a slot don't mix."""
    r = random.Random(9)
    rows = [(f"k{r.randint(0, 2_000)}", k, START + dt.timedelta(minutes=r.randint(0, 6_000))) for k in range(8_000)]
    rows += [(None, k, START + dt.timedelta(hours=k - 8_000)) for k in range(8_000, 8_100)] + [("k1", 9_000, None), ("never", 9_001, None)]
    table = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = limits.event_log(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), hours=48, slots=slots)
    sink = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    try:
        job = sink.trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = list(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert len(found) == len(set(found)) and set(found) == plain_log([x for x in rows if x[2] is not None], 48)
    first = job.recentProgress[0]["stateOperators"][0]
    assert 0 < first["numRowsUpdated"] <= 3 * slots


def test_event_log_slots_forget_what_has_run_out(spark, tmp_path):
    """Ends behind the watermark leave a slot with its next events; an idle slot is cleared by its timer."""
    days = [[("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], [("b", 4, 400)], [("b", 5, 401), ("a", 6, 402)], [("a", 7, 420), ("c", 8, 452)], [("c", 9, 1000)]]
    for k, day in enumerate(days):
        rows = [(key, e, START + dt.timedelta(hours=h)) for key, e, h in day]
        spark.createDataFrame(rows, "key string, event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    for slots in (1, 64):  # all keys in one slot, each in its own
        stream = spark.readStream.schema("key string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        found = run_available(limits.event_log(stream, hours=48, late="96 hours", slots=slots), str(tmp_path / f"log{slots}"))
        assert set(map(tuple, found.collect())) == plain_log([(key, e, START + dt.timedelta(hours=h)) for day in days for key, e, h in day], 48)


class Held:
    """One slot's state and timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_event_log_slot_keeps_live_keys_and_one_timer():
    hour, handle = 3_600_000_000, Held()
    log = limits._Log(48 * hour)
    log.init(handle)

    def batch(rows, watermark):
        frame = pd.DataFrame(rows, columns=["key", "event_id", "us"])
        return [e for out in log.handleInputRows((0,), iter([frame]), TimerValues(-1, watermark * 3_600_000)) for e in out["event_id"]]

    assert sorted(batch([("a", 2, 120 * hour), ("a", 1, 100 * hour), ("b", 3, 110 * hour), ("a", 4, 148 * hour)], 0)) == [1, 3, 4]
    assert dict(zip(*handle.value, strict=True)) == {"a": 196 * hour, "b": 158 * hour} and handle.timers == {196 * 3_600_000 + 1}
    assert batch([("a", 5, 190 * hour), ("c", 6, 170 * hour)], 160) == [6]
    assert dict(zip(*handle.value, strict=True)) == {"a": 196 * hour, "c": 218 * hour} and handle.timers == {218 * 3_600_000 + 1}
    assert not list(log.handleExpiredTimer((0,), None, ExpiredTimerInfo(196 * 3_600_000 + 1))) and handle.value
    assert not list(log.handleExpiredTimer((0,), None, ExpiredTimerInfo(218 * 3_600_000 + 1))) and handle.value is None
