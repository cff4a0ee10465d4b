"""Alert rules while data arrives: sustained conditions, slow tasks by sketch, unfinished tasks, late features.

The batch twins are in ``operators.alerts``.  Windows come out when the watermark has
closed them, so a stream agrees with its twin up to the last watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motorlens.functions.shipping import by_value

by_value(__name__)

# values a sketch keeps on each level: ranks are off by about 0.4 % of a window's rows (99 times in 100); exact up to as many rows
SKETCH_SIZE = 800
RANK_ERROR = 0.004
FIRING, CLEARED = "firing", "cleared"
# after this a task without a finish counts as one that never ends
UNFINISHED_AFTER_SECONDS = 3600
EARLIEST_US = -9_223_372_036_854_776
# groups over which tasks are dealt; a bucket holds its tasks of one batch
TASK_BUCKETS = 2048


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_window_ratios(
    events: DataFrame, bad: Column, keys: list[str], window: str, ts: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """Closed windows with their share of bad events; ``closed_at`` carries the watermark on."""
    counted = _timed(events, ts, delay).groupBy(*keys, F.window(ts, window).alias("_span")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))
    return counted.select(
        *keys, F.col("_span.start").alias("window_start"), F.window_time("_span").alias("closed_at"), "total", "bad",
        (F.col("bad") / F.col("total")).alias("ratio"))


class _Sustained(StatefulProcessor):
    """The newest firing window of a key and how many adjacent ones end there."""

    def __init__(self, keys: list[str], step: int, times: int) -> None:
        self.keys, self.step, self.times = keys, step, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last_us bigint, held int")

    def _rows(self, key: tuple, found: list[tuple[int, int, str]]) -> pd.DataFrame:
        columns = {k: [v] * len(found) for k, v in zip(self.keys, key)}
        return pd.DataFrame(columns | {
            "window_start": pd.to_datetime([f[0] for f in found], unit="us"), "held_windows": [f[1] for f in found], "event": [f[2] for f in found]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, held = self.run.get() if self.run.exists() else (None, 0)
        found: list[tuple[int, int, str]] = []
        for start in sorted(int(t.value) // 1000 for frame in rows for t in frame["window_start"]):
            if last is not None and start != last + self.step:
                if held >= self.times:
                    found.append((last + self.step, held, CLEARED))
                held = 0
            last, held = start, held + 1
            if held >= self.times:
                found.append((start, held, FIRING))
        if last is not None:
            self.run.update((last, held))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # the next window is known when the watermark has passed its end
            self.handle.registerTimer((last + 2 * self.step) // 1000)
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, held = self.run.get() if self.run.exists() else (None, 0)
        # a later window may have come in the batch in which the timer went off
        if last is None or (last + 2 * self.step) // 1000 > timerValues.getCurrentWatermarkInMs():
            return
        self.run.clear()
        if held >= self.times:
            yield self._rows(key, [(last + self.step, held, CLEARED)])

    def close(self) -> None:
        pass


@contextmanager
def row_state(spark: SparkSession) -> Iterator[None]:
    """State kept row by row in RocksDB for queries started inside, as state machines with timers need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_sustained(windows: DataFrame, firing: Column, keys: list[str], window_seconds: int, times: int) -> DataFrame:
    """``(keys, window_start, held_windows, event)``: a state machine per key over closed windows.

    A key fires at every window at which the condition has held ``times`` adjacent windows
    in a row, and is cleared, once, at the first window after that at which it does not:
    when a later window shows the gap, or else by a timer when the watermark has closed
    that window.  ``held_windows`` of a clearing is the length of the row that ended.
    Start the query inside ``row_state``.
    """
    kinds = {f.name: f for f in windows.schema.fields}
    out = T.StructType([*(kinds[k] for k in keys), T.StructField("window_start", T.TimestampType()),
                        T.StructField("held_windows", T.IntegerType()), T.StructField("event", T.StringType())])
    held = windows.where(firing).select(*keys, "window_start", "closed_at")
    return held.groupBy(*keys).transformWithStateInPandas(_Sustained(keys, window_seconds * 1_000_000, times), out, "Append", "EventTime")


def stream_p95(
    events: DataFrame, value: str, keys: list[str], window: str, limit: float, ts: str = "ts", delay: str = "10 minutes",
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """Closed windows whose 95th percentile, by a sketch, is above ``limit``.

    The state of a key and window is a quantile sketch of bounded size, whatever the
    number of rows.  Tasks sketch their own rows and only sketches are shuffled, so a key
    with most of the rows is no hot one.  The percentile is a value that occurs, with a
    rank within ``RANK_ERROR`` of 95 %.
    """
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size))
    sketched = _timed(events.where(F.col(value).isNotNull()), ts, delay).groupBy(*keys, F.window(ts, window).alias("_span")).agg(
        sketch.alias("_sketch"), F.count(F.lit(1)).alias("events"))
    quantile = F.kll_sketch_get_quantile_double("_sketch", F.lit(0.95).cast("double"))
    return sketched.select(*keys, F.col("_span.start").alias("window_start"), quantile.alias("p95"), "events").where(F.col("p95") > limit)


def stream_task_runs(
    events: DataFrame, after: int = UNFINISHED_AFTER_SECONDS, delay: str = "10 minutes", buckets: int = TASK_BUCKETS
) -> DataFrame:
    """Task runs from a stream of ``(task_id, task_name, worker, kind, state, ts)``, each reported once.

    Start and finish of a task wait for each other in either order.  A task that has no
    finish ``after`` seconds behind its start, by the watermark, comes out without state,
    finish and duration; a finish without a start is forgotten then.

    Tasks are dealt out over ``buckets`` by a hash of their id.  A bucket is one group that
    keeps its open tasks, so Python is called per bucket and batch and not per task.  Ids
    are texts or whole numbers.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    named = [T.StructField("task_name", kinds["task_name"]), T.StructField("worker", kinds["worker"])]
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("started", T.LongType()), *named,
                        T.StructField("finished", T.LongType()), T.StructField("state", T.StringType())])
    # the open tasks of a bucket, column by column, and the watermark behind which each is given up
    held = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*out.fields, T.StructField("due", T.LongType())]])

    def plain(value):
        """A number or text as the state keeps it; pandas holds whole numbers beside missing ones as floats."""
        if value is None or value != value:
            return None
        return value.item() if hasattr(value, "item") else value

    def whole(value):
        value = plain(value)
        return int(value) if isinstance(value, float) else value

    worker = whole if isinstance(kinds["worker"], T.IntegralType) else plain

    def pair(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        open_ = {task: run for task, *run in zip(*state.get)} if state.exists else {}
        touched = set()
        if not state.hasTimedOut:
            for frame in frames:
                for task, kind, name, who, end, at in zip(*(frame[c] for c in ("id", "kind", "task_name", "worker", "state", "at"))):
                    touched.add(task)
                    run = open_.setdefault(task, [None] * 6)
                    if kind == "start" and (run[0] is None or at < run[0]):
                        run[:3] = int(at), plain(name), worker(who)
                    elif kind == "finish" and (run[3] is None or at < run[3]):
                        run[3:5] = int(at), plain(end)
        done = []
        for task, run in list(open_.items()):
            if task in touched:
                known = run[0] if run[0] is not None else run[3]
                if run[0] is not None and run[3] is not None:
                    done.append((task, *open_.pop(task)[:5]))
                else:
                    run[5] = max(known // 1000 + after * 1000, now + 1)
            elif run[5] < now:
                del open_[task]
                if run[0] is not None:
                    done.append((task, *run[:5]))
        if open_:
            state.update(tuple(map(list, zip(*((task, *run) for task, run in open_.items())))))
            state.setTimeoutTimestamp(max(min(run[5] for run in open_.values()), now + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({f.name: pd.Series(c, dtype=object) for f, c in zip(out.fields, zip(*done))})

    # an unknown time counts as the earliest one
    at = F.coalesce(F.unix_micros("ts"), F.lit(EARLIEST_US))
    rows = _timed(events.select("task_id", "task_name", "worker", "kind", "state", "ts"), "ts", delay).select(
        F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket"), F.col("task_id").cast("string").alias("id"),
        "task_name", "worker", "kind", "state", at.alias("at"), "ts")
    runs = rows.groupBy("bucket").applyInPandasWithState(pair, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    seconds = (F.col("finished") - F.col("started")) / F.lit(1e6)
    return runs.select(
        F.col("id").cast(kinds["task_id"]).alias("task_id"), "task_name", "worker", F.timestamp_micros("started").alias("started_at"), "state",
        F.timestamp_micros("finished").alias("finished_at"), seconds.alias("duration_seconds"))


def stream_late_features(
    signals: DataFrame, features: DataFrame, limit: int, delay: str = "10 minutes"
) -> DataFrame:
    """Signals ``(signal_id, equipment_id, recorded_at)`` and the features ``(feature_id, signal_id, created_at)`` made of them in time.

    An outer join of two streams with watermarks on both sides: a signal comes out with
    each feature made within ``limit`` seconds, or once without any when the watermark
    has passed its time, and neither side is kept longer.
    """
    left = _timed(signals.select("signal_id", "equipment_id", "recorded_at"), "recorded_at", delay)
    right = _timed(features.select(F.col("signal_id").alias("_signal"), "feature_id", "created_at"), "created_at", delay)
    near = (F.col("created_at") >= F.col("recorded_at")) & (F.col("created_at") <= F.col("recorded_at") + F.expr(f"interval {limit} seconds"))
    joined = left.join(right, (F.col("signal_id") == F.col("_signal")) & near, "left_outer")
    return joined.select("signal_id", "equipment_id", "recorded_at", "feature_id", "created_at")


def stream_forecast_backlog(
    forecasts: DataFrame, anomalies: DataFrame, share: float, window: str = "1 hour", ts: str = "created_at", delay: str = "10 minutes"
) -> DataFrame:
    """Closed windows in which fewer forecasts were made than ``share`` of the anomalies found.

    Both streams are counted by window and the counts joined from both sides, so windows
    with anomalies alone come out too.
    """
    made = _timed(forecasts, ts, delay).groupBy(F.window(ts, window).alias("span")).agg(F.count(F.lit(1)).alias("forecasts"))
    found = _timed(anomalies, ts, delay).groupBy(F.window(ts, window).alias("span")).agg(F.count(F.lit(1)).alias("anomalies"))
    joined = found.join(made, "span", "left_outer").select(
        F.col("span.start").alias("window_start"), F.coalesce("forecasts", F.lit(0)).cast("bigint").alias("forecasts"), "anomalies")
    return joined.where(F.col("forecasts") < F.col("anomalies") * share)
