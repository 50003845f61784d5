"""Rate limits with anchored windows in batch and as a stateful stream, the event log, the breaker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..storage import materialise

#: Requests of a source up to which one task reads them in order; results do not depend on it.
STREAMED = 2_000_000
_OUT = "source long, event_id long, ts timestamp, window_start timestamp, n long, allowed boolean"


def _place(key, event_id, micros, state, window: int, limit: int, count_denied: bool):
    """(window start, number in window, allowed) of one request, and the new state.

    A window starts at the first request after the last one ended, not on the clock.
    """
    held_key, start, n = state
    if key != held_key or micros >= start + window:
        return (micros, 1, limit >= 1), (key, micros, 1)
    allowed = n + 1 <= limit
    kept = n + 1 if allowed or count_denied else n
    return (start, n + 1, allowed), (key, start, kept)


def _bucket(micros: str, length: int) -> Column:
    """Number of the stretch of ``length`` that a time is in, exactly."""
    return F.expr(f"({micros} - pmod({micros}, {length}L)) div {length}L")


def _by_bucket(order: str) -> WindowSpec:
    return Window.partitionBy("source", "bucket").orderBy(order)


def _neighbours(points: DataFrame) -> DataFrame:
    """Per source and bucket: the last time before it, and the first times of the next two buckets that have any.

    Buckets are as long as a window, so a source has one row per window of its history here, not per request.
    """
    ends = points.groupBy("source", "bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    along = Window.partitionBy("source").orderBy("bucket")
    names = {"before": F.lag("last"), "next_bucket": F.lead("bucket"), "next_first": F.lead("first"), "second_first": F.lead("first", 2)}
    return ends.select("source", "bucket", *(f.over(along).alias(n) for n, f in names.items()))


def _successors(points: DataFrame, window: int) -> DataFrame:
    """(source, us, next): the first time at or behind the end of a window that starts at ``us``.

    The end falls into the next bucket: looked up there by one pass over times and ends in order, else the first time of
    the bucket after that.
    """
    far = F.when(F.col("next_bucket") == F.col("bucket") + 1, F.col("second_first")).otherwise(F.col("next_first"))
    ends = points.select("source", (F.col("bucket") + 1).alias("bucket"), (F.col("us") + window).alias("at"), F.lit(1).alias("kind"), F.col("us").alias("of"), far.alias("far"))
    times = points.select("source", "bucket", F.col("us").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of"), F.lit(None).cast("long").alias("far"))
    backwards = Window.partitionBy("source", "bucket").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(backwards)
    found = times.unionByName(ends).withColumn("next", F.coalesce(near, "far")).filter("kind = 1 AND next IS NOT NULL")
    return found.select("source", F.col("of").alias("us"), "next")


def window_starts(points: DataFrame, window: int) -> DataFrame:
    """(source, us): where the anchored windows of each source start; ``points`` are its distinct times with their bucket.

    A time a window's length or more behind the one before starts a window whatever came earlier.  From there windows
    follow one another along the successors; which times that reaches is found by pointer doubling, so a chain of n
    windows takes log2(n) rounds, and a hot source's times are dealt over all tasks in each.
    """
    points = materialise(points.join(_neighbours(points), ["source", "bucket"]))
    before = F.coalesce(F.lag("us").over(_by_bucket("us")), F.col("before"))
    fresh = points.withColumn("gap", F.col("us") - before).filter(F.col("gap").isNull() | (F.col("gap") >= window)).select("source", "us")
    starts = materialise(fresh)
    # A chain ends where a fresh start takes over.
    known = starts.withColumnRenamed("us", "next")
    jumps = materialise(_successors(points, window).join(known, ["source", "next"], "left_anti"))
    while jumps.limit(1).count():
        reached = starts.join(jumps, ["source", "us"]).select("source", F.col("next").alias("us"))
        starts = materialise(starts.unionByName(reached).distinct())
        onward = jumps.select("source", F.col("us").alias("next"), F.col("next").alias("onward"))
        jumps = materialise(jumps.join(onward, ["source", "next"]).select("source", "us", F.col("onward").alias("next")))
    return starts


def anchored_windows(events: DataFrame, seconds: int, limit: int = C.SEARCH_LIMIT, count_denied: bool = True) -> DataFrame:
    """Requests (source, event_id, ts) with their window, their number in it and whether they pass.

    A window starts at the first request after the last one ended, not on the clock.  Where denied requests are not
    counted, numbers stop behind the limit.  Sources of up to ``STREAMED`` requests are read in order, a task holding the
    current window only; the others, which would wait for one task, are dealt over all tasks (see ``_spread``).
    """
    events = events.select("source", "event_id", "ts")
    hot = events.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > STREAMED).select("source")
    if not hot.limit(1).count():
        return _in_order(events, seconds, limit, count_denied)
    hot = materialise(hot)
    cold = _in_order(events.join(hot, "source", "left_anti"), seconds, limit, count_denied)
    return cold.unionByName(_spread(events.join(hot, "source", "left_semi"), seconds, limit, count_denied))


def _in_order(events: DataFrame, seconds: int, limit: int, count_denied: bool) -> DataFrame:
    """Windows and numbers by reading each source's requests as a stream."""
    window, names = seconds * 1_000_000, [f.split()[0] for f in _OUT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (None, 0, 0)
        for batch in batches:
            keys, ids, ts = (batch.column(c) for c in ("source", "event_id", "ts"))
            out = []
            for key, event_id, at in zip(keys.to_pylist(), ids.to_pylist(), ts.cast(pa.int64()).to_pylist(), strict=True):
                row, state = _place(key, event_id, at, state, window, limit, count_denied)
                out.append(row)
            starts, counts, allowed = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([keys, ids, ts, pa.array(starts, pa.int64()).cast(ts.type), pa.array(counts, pa.int64()), pa.array(allowed, pa.bool_())], names=names)

    return events.repartition("source").sortWithinPartitions("source", "ts", "event_id").mapInArrow(run, _OUT)


def _spread(events: DataFrame, seconds: int, limit: int, count_denied: bool) -> DataFrame:
    """The same with nothing partitioned by source alone but one row per bucket."""
    window = seconds * 1_000_000
    timed = events.withColumn("us", F.unix_micros("ts")).withColumn("bucket", _bucket("us", window))
    starts = window_starts(materialise(timed.select("source", "us", "bucket").distinct()), window)
    marked = starts.select("source", "us", _bucket("us", window).alias("bucket"), F.col("us").alias("start"))
    # The start at or before a request is in its bucket, or else the last one of the buckets before.
    buckets = timed.select("source", "bucket").distinct().join(marked.groupBy("source", "bucket").agg(F.max("start").alias("own")), ["source", "bucket"], "left")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("source", "bucket", F.max("own").over(earlier).alias("carried"))
    so_far = F.last("start", ignorenulls=True).over(_by_bucket("us").rangeBetween(Window.unboundedPreceding, 0))
    placed = timed.join(marked.drop("bucket"), ["source", "us"], "left").withColumn("own", so_far).join(carried, ["source", "bucket"])
    placed = placed.withColumn("start", F.coalesce("own", "carried"))
    place = F.row_number().over(Window.partitionBy("source", "start").orderBy("us", "event_id")).cast("long")
    n = place if count_denied else F.least(place, F.lit(limit + 1).cast("long"))
    return placed.select("source", "event_id", "ts", F.timestamp_micros("start").alias("window_start"), n.alias("n"), (place <= limit).alias("allowed"))


def anchored_window_stream(events: DataFrame, seconds: int, limit: int = C.SEARCH_LIMIT, count_denied: bool = True) -> DataFrame:
    """The same over a stream: one window start and count per source is kept as state."""
    window = seconds * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = (key[0], *state.get) if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        micros = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
        out = []
        for event_id, at in zip(rows["event_id"].tolist(), micros, strict=True):
            row, held = _place(key[0], event_id, at, held, window, limit, count_denied)
            out.append((key[0], event_id, pd.Timestamp(at, unit="us"), pd.Timestamp(row[0], unit="us"), row[1], row[2]))
        state.update(held[1:])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _OUT.split(", ")])

    grouped = events.select("source", "event_id", "ts").groupBy("source")
    return grouped.applyInPandasWithState(step, _OUT, "start long, n long", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests per endpoint and hour with a watermark for late rows; batch or stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", "1 hour"), "endpoint").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "endpoint", "n")


def distinct_events(events: DataFrame, late: str = "48 hours") -> DataFrame:
    """Each event once, within the watermark for a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


_LOG = "key string, event_id long, ts long, expires long"
#: Rows of a slot that are looked at as Python numbers at a time.
_PIECE = 65_536


class _Log(StatefulProcessor):
    """Per slot of keys the ends of their latest entries, in one value that is read and written once a batch."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "keys array<string>, until array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.live.get()
        keys, until = (list(held[0]), list(held[1])) if held else ([], [])
        timer = max(until, default=None)
        place = {k: n for n, k in enumerate(keys)}
        codes, ids, times = [], [], []
        for frame in rows:
            codes.append(np.array([place.setdefault(k, len(place)) for k in frame["key"].tolist()], np.int64))
            ids.append(frame["event_id"].to_numpy())
            times.append(frame["us"].to_numpy())
        keys, until = list(place), until + [None] * (len(place) - len(until))
        codes, ids, times = (np.concatenate(c) for c in (codes, ids, times))
        order = np.lexsort((ids, times, codes))
        for start in range(0, len(order), _PIECE):
            piece = order[start : start + _PIECE]
            taken = []
            for row, code, at in zip(piece.tolist(), codes[piece].tolist(), times[piece].tolist(), strict=True):
                if until[code] is None or at >= until[code]:
                    until[code] = at + self.micros
                    taken.append(row)
            if taken:
                yield pd.DataFrame({"key": [keys[c] for c in codes[taken].tolist()], "event_id": ids[taken], "ts": times[taken], "expires": times[taken] + self.micros})
        # What the watermark has passed is taken anew with its end or without.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        left = [n for n, end in enumerate(until) if end > passed]
        self.live.update(([keys[n] for n in left], [until[n] for n in left]))
        if timer != max(until):
            if timer is not None:
                self.handle.deleteTimer(timer // 1000 + 1)
            self.handle.registerTimer(max(until) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The latest end's own timer clears the slot; an earlier one finds it still running.
        held = self.live.get()
        if held and all(end // 1000 < expiredTimerInfo.getExpiryTimeInMs() for end in held[1]):
            self.live.clear()
        return iter(())

    def close(self) -> None:
        pass


def event_log(events: DataFrame, hours: int = 48, late: str = "48 hours", slots: int = 4096) -> DataFrame:
    """A stream of events (key, event_id, ts) as a log in which a key counts once until its entry runs out.

    The first event of a key is taken, with when it expires; repeats until then are dropped, and the next one after is
    taken anew.  State is one number per live key, in the state store: keys are held in slots by hash, so that a batch
    asks the store once per slot, not per key.  Ends that the watermark has passed go with a slot's next events, or by a
    timer once its last one has been passed; events later than the watermark are dropped.  A slot's events of a batch are
    put in order in one task, as plain numbers.  ``slots`` belongs to a stream's state and stays for its life.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")
    timed = events.select(slot.alias("slot"), "key", "event_id", F.unix_micros("ts").alias("us"), "ts").filter("ts IS NOT NULL").withWatermark("ts", late)
    log = timed.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_Log(hours * 3_600_000_000), outputStructType=_LOG, outputMode="Append", timeMode="EventTime"
    )
    return log.select("key", "event_id", *(F.timestamp_micros(c).alias(c) for c in ("ts", "expires")))


def breaker_open(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Whether a source is skipped at each request: blocked within the last minutes and not cleared since.

    A block opens the breaker, a result closes it.  Time is cut into buckets of the breaker's length: what decides is the
    last such event of the request's own bucket, else of the one before, as older ones have run out.  So no window holds
    more than a source's requests of one bucket.
    """
    length = minutes * 60 * 1_000_000
    decisive = F.when(F.col("status").isin("blocked", "ok", "slow"), F.struct("ts", "event_id", "status"))
    timed = events.withColumns({"bucket": _bucket("unix_micros(ts)", length), "_d": decisive})
    last = timed.groupBy("source", "bucket").agg(F.max("_d").alias("_last")).withColumn("bucket", F.col("bucket") + 1)
    before = Window.partitionBy("source", "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    held = timed.withColumn("_own", F.last("_d", ignorenulls=True).over(before)).join(last, ["source", "bucket"], "left")
    held = held.withColumn("_h", F.coalesce("_own", "_last"))
    until = F.col("_h.ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    skipped = F.coalesce((F.col("_h.status") == "blocked") & (F.col("ts") < until), F.lit(False))
    return held.select(*events.columns, skipped.alias("skipped"))
