"""Alert rules as batch queries over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.clock import Moment, floor_to, moment, seconds_between
from motorlens.functions.ordering import running_total
from motorlens.functions.quantiles import exact_quantiles

# fixed values of the rules
SILENT_AFTER_SECONDS = 3600
EXTRACTION_LAG_SECONDS = 1800
BACKLOG_SHARE = 0.1
SLOW_TASK_SECONDS = 60
DURATION_BUCKETS = [0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0]


def _windowed(df: DataFrame, ts: str, window: str) -> DataFrame:
    spans = F.window(ts, window)
    return df.withColumn("_span", spans).withColumn("window_start", F.col("_span.start")).withColumn(
        "window_seconds", seconds_between("_span.start", "_span.end")
    ).drop("_span")


def hourly_rms_windows(readings: DataFrame, window: str = "1 hour") -> DataFrame:
    """Batch twin of the streaming hourly RMS."""
    return (
        _windowed(readings.where(F.col("value").isNotNull()), "ts", window)
        .groupBy("equipment_id", "phase", "window_start")
        .agg(
            F.avg("value").alias("mean_rms"), F.min("value").alias("min_rms"), F.max("value").alias("max_rms"),
            F.count(F.lit(1)).alias("readings"),
        )
    )


def sliding_suspicious(audit: DataFrame, window: str = "1 hour", slide: str = "5 minutes", attempts: int = 5) -> DataFrame:
    """Batch twin of the streaming watch on failed logins: any sliding window with enough attempts."""
    bad = audit.where(F.col("action_type").isin("failed_login", "permission_denied"))
    return (
        bad.groupBy("user_id", "username", "request_ip", F.window("ts", window, slide).alias("_span"))
        .agg(F.count(F.lit(1)).alias("failed_attempts"))
        .where(F.col("failed_attempts") >= attempts)
        .select("user_id", "username", "request_ip", F.col("_span.start").alias("window_start"), "failed_attempts")
    )


def silent_machines(equipment: DataFrame, events: DataFrame, as_of: Moment, after: int = SILENT_AFTER_SECONDS) -> DataFrame:
    """Machines without data for too long, including those that never sent any."""
    newest = events.where(F.col("ts") <= moment(as_of)).groupBy("equipment_id").agg(F.max("ts").alias("last_seen"))
    silence = seconds_between("last_seen", moment(as_of))
    return (
        equipment.select("equipment_id")
        .join(newest, "equipment_id", "left")
        .withColumn("silent_seconds", silence)
        .where(F.col("last_seen").isNull() | (F.col("silent_seconds") > after))
    )


def rate_alert(events: DataFrame, keys: list[str], window: str, limit: float, ts: str = "ts") -> DataFrame:
    """Windows with more than ``limit`` events per second."""
    return (
        _windowed(events, ts, window)
        .groupBy(*keys, "window_start", "window_seconds")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("per_second", F.col("events") / F.col("window_seconds"))
        .where(F.col("per_second") > limit)
        .drop("window_seconds")
    )


def failure_rate_alert(
    events: DataFrame, failed: Column, keys: list[str], window: str, limit: float, ts: str = "ts"
) -> DataFrame:
    """Windows with more than ``limit`` failures per second."""
    return rate_alert(events.where(failed), keys, window, limit, ts)


def window_ratios(events: DataFrame, bad: Column, keys: list[str], window: str, ts: str = "ts") -> DataFrame:
    return (
        _windowed(events, ts, window)
        .groupBy(*keys, "window_start")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"))
        .withColumn("ratio", F.col("bad") / F.col("total"))
    )


def ratio_alert(
    events: DataFrame, bad: Column, keys: list[str], window: str = "5 minutes", limit: float = 0.05, ts: str = "ts"
) -> DataFrame:
    """Windows whose bad share is above ``limit``."""
    return window_ratios(events, bad, keys, window, ts).where(F.col("ratio") > limit)


def p95_alert(events: DataFrame, value: str, keys: list[str], window: str, limit: float, ts: str = "ts") -> DataFrame:
    """Windows whose exact 95th percentile is above ``limit``."""
    found = exact_quantiles(_windowed(events, ts, window), [*keys, "window_start"], value, [0.95])
    return found.where(F.col("quantile") > limit).select(
        *keys, "window_start", F.col("quantile").alias("p95"), F.col("n").alias("events")
    )


def sustained(windows: DataFrame, firing: Column, keys: list[str], window_seconds: int, times: int) -> DataFrame:
    """Windows at which a condition has held for ``times`` adjacent windows in a row."""
    held = windows.where(firing)
    order = Window.partitionBy(*keys).orderBy("window_start")
    gap = seconds_between(F.lag("window_start").over(order), "window_start")
    breaks = F.when(gap == window_seconds, 0).otherwise(1)
    island = F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = Window.partitionBy(*keys, "_island").orderBy("window_start")
    return (
        held.withColumn("_break", breaks)
        .withColumn("_island", island)
        .withColumn("held_windows", F.row_number().over(run))
        .where(F.col("held_windows") >= times)
        .drop("_break", "_island")
    )


def critical_increase(located: DataFrame, window: str = "1 hour") -> DataFrame:
    """Machines with any new critical anomaly, per window."""
    critical = located.where(F.col("predicted_severity") == "critical")
    return (
        _windowed(critical, "created_at", window)
        .groupBy("equipment_id", "window_start")
        .agg(F.count(F.lit(1)).alias("critical_anomalies"))
    )


def forecast_backlog(forecasts: DataFrame, anomalies: DataFrame, share: float = BACKLOG_SHARE, unit: str = "hour") -> DataFrame:
    """Hours in which fewer forecasts were made than ``share`` of the anomalies found."""
    made = forecasts.groupBy(floor_to(unit, "created_at").alias("window_start")).agg(F.count(F.lit(1)).alias("forecasts"))
    found = anomalies.groupBy(floor_to(unit, "created_at").alias("window_start")).agg(F.count(F.lit(1)).alias("anomalies"))
    return (
        made.join(found, "window_start", "full_outer")
        .fillna(0, subset=["forecasts", "anomalies"])
        .where(F.col("forecasts") < F.col("anomalies") * share)
    )


def extraction_lag(signals: DataFrame, located_features: DataFrame, limit: int = EXTRACTION_LAG_SECONDS) -> DataFrame:
    """Machines whose newest feature is too far behind their newest signal; no feature at all also counts."""
    newest_signal = signals.groupBy("equipment_id").agg(F.max("recorded_at").alias("last_signal_at"))
    newest_feature = located_features.groupBy("equipment_id").agg(F.max("window_start").alias("last_feature_at"))
    return (
        newest_signal.join(newest_feature, "equipment_id", "left")
        .withColumn("lag_seconds", seconds_between("last_feature_at", "last_signal_at"))
        .where(F.col("last_feature_at").isNull() | (F.col("lag_seconds") > limit))
    )


def histogram(events: DataFrame, value: str, labels: list[str], buckets: list[float] = DURATION_BUCKETS) -> DataFrame:
    """Cumulative bucket counts with sum and count per label set; the last bucket is infinity (NULL bound)."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    totals = events.groupBy(*labels).agg(
        *counts, F.count(value).alias("observations"), F.sum(value).alias("total")
    )
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(buckets)]
    entries.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("observations").alias("bucket")))
    return totals.select(*labels, "observations", "total", F.inline(F.array(*entries)))


def task_durations(events: DataFrame) -> DataFrame:
    """Task runs from start and finish events ``(task_id, task_name, worker, kind, state, ts)``."""
    started = events.where(F.col("kind") == "start").select("task_id", "task_name", "worker", F.col("ts").alias("started_at"))
    finished = events.where(F.col("kind") == "finish").select("task_id", "state", F.col("ts").alias("finished_at"))
    return started.join(finished, "task_id", "left").withColumn(
        "duration_seconds", seconds_between("started_at", "finished_at")
    )


def task_metrics(runs: DataFrame, slow: int = SLOW_TASK_SECONDS) -> DataFrame:
    return runs.groupBy("task_name", F.coalesce("state", F.lit("running")).alias("status")).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg("duration_seconds").alias("mean_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
        F.count_if(F.col("duration_seconds") > slow).alias("slow_tasks"),
    )


def active_tasks(events: DataFrame) -> DataFrame:
    """Number of running tasks per worker after every event; a finish counts before a start at the same time."""
    steps = events.withColumn("_step", F.when(F.col("kind") == "start", 1).otherwise(-1))
    return running_total(steps, ["worker"], "ts", ["_step", "task_id"], "_step", "active_tasks").drop("_step")
