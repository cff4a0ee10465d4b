"""Registered queries: alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.operators import alerts as L
from motorlens.operators import reports as R
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.sources import star_tables as S

AS_OF = "2024-01-30 00:00:00"
NOW = "TIMESTAMP '2024-01-30'"


@query(
    "hourly_rms_windows",
    with_frames(
        "readings",
        f"""SELECT equipment_id, phase, date_trunc('hour', ts)::TIMESTAMP AS window_start, {r6('avg(value)')} AS mean_rms,
                   {r6('min(value)')} AS min_rms, {r6('max(value)')} AS max_rms, count(*) AS readings
            FROM readings WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)
def hourly_rms_windows(spark, sf_dir):
    return L.hourly_rms_windows(S.readings(spark, sf_dir))


@query(
    "sliding_suspicious",
    with_frames(
        "audit",
        """SELECT user_id, username, request_ip, window_start, count(*) AS failed_attempts
           FROM (SELECT *, unnest(range(0, 4)) AS k FROM audit WHERE action_type IN ('failed_login', 'permission_denied')) a,
                LATERAL (SELECT time_bucket(INTERVAL 12 HOUR, a.ts) - a.k * INTERVAL 12 HOUR AS window_start) w
           GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    ),
)
def sliding_suspicious(spark, sf_dir):
    return L.sliding_suspicious(S.audit(spark, sf_dir), "48 hours", "12 hours", 3)


@query(
    "silent_machines",
    with_frames(
        "durations",
        f"""SELECT e.equipment_id, d.last_seen, {r6(f"(epoch_us({NOW}) - epoch_us(d.last_seen)) / 1e6")} AS silent_seconds
            FROM (SELECT DISTINCT user_id AS equipment_id FROM events) e
            LEFT JOIN (SELECT user_id AS equipment_id, max(ts) AS last_seen FROM events
                       WHERE ts <= {NOW} AND event_type <> 'error' GROUP BY 1) d USING (equipment_id)
            WHERE d.last_seen IS NULL OR (epoch_us({NOW}) - epoch_us(d.last_seen)) / 1e6 > 3600""",
    ),
)
def silent_machines(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").withColumn("equipment_id", F.col("user_id"))
    return L.silent_machines(
        events.select("equipment_id").distinct(), events.where(F.col("event_type") != "error"), AS_OF
    )


@query(
    "rate_alert",
    with_frames(
        "durations",
        f"""SELECT task_name, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS events,
                   {r6('count(*) / 3600')} AS per_second
            FROM durations GROUP BY 1, 2 HAVING count(*) / 3600 > 0.0015""",
    ),
)
def rate_alert(spark, sf_dir):
    return L.rate_alert(S.durations(spark, sf_dir), ["task_name"], "1 hour", 0.0015)


@query(
    "failure_rate_alert",
    with_frames(
        "audit",
        f"""SELECT user_role, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS events,
                   {r6('count(*) / 600')} AS per_second
            FROM audit WHERE result = 'failure' GROUP BY 1, 2 HAVING count(*) / 600 > 0.002""",
    ),
)
def failure_rate_alert(spark, sf_dir):
    return L.failure_rate_alert(S.audit(spark, sf_dir), F.col("result") == "failure", ["user_role"], "10 minutes", 0.002)


RATIOS = """
ratios AS (
    SELECT user_role, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total,
           count(*) FILTER (result <> 'success') AS bad FROM audit GROUP BY 1, 2),"""


@query(
    "ratio_alert",
    with_frames(
        "audit",
        f"SELECT user_role, window_start, total, bad, {r6('bad / total')} AS ratio FROM ratios WHERE bad / total > 0.5",
        RATIOS,
    ),
)
def ratio_alert(spark, sf_dir):
    return L.ratio_alert(S.audit(spark, sf_dir), F.col("result") != "success", ["user_role"], "1 hour", 0.5)


@query(
    "sustained",
    with_frames(
        "audit",
        f"""SELECT user_role, window_start, total, bad, {r6('bad / total')} AS ratio, held_windows FROM (
               SELECT *, row_number() OVER (PARTITION BY user_role, island ORDER BY window_start)::INT AS held_windows FROM (
                   SELECT *, window_start - row_number() OVER (PARTITION BY user_role ORDER BY window_start) * INTERVAL 1 HOUR AS island
                   FROM ratios WHERE bad / total > 0.3))
            WHERE held_windows >= 3""",
        RATIOS,
    ),
)
def sustained(spark, sf_dir):
    ratios = L.window_ratios(S.audit(spark, sf_dir), F.col("result") != "success", ["user_role"], "1 hour")
    return L.sustained(ratios, F.col("ratio") > 0.3, ["user_role"], 3600, 3)


@query(
    "p95_alert",
    with_frames(
        "durations",
        f"""SELECT task_name, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, {r6('quantile_cont(seconds, 0.95)')} AS p95,
                   count(seconds) AS events
            FROM durations GROUP BY 1, 2 HAVING quantile_cont(seconds, 0.95) > 120""",
    ),
)
def p95_alert(spark, sf_dir):
    return L.p95_alert(S.durations(spark, sf_dir), "seconds", ["task_name"], "6 hours", 120)


@query(
    "critical_increase",
    with_frames(
        "located_predictions",
        """SELECT equipment_id, date_trunc('hour', created_at)::TIMESTAMP AS window_start, count(*) AS critical_anomalies
           FROM located_predictions WHERE predicted_severity = 'critical' GROUP BY 1, 2""",
    ),
)
def critical_increase(spark, sf_dir):
    located = R.locate_predictions(S.predictions(spark, sf_dir), S.features(spark, sf_dir), S.signals(spark, sf_dir))
    return L.critical_increase(located)


@query(
    "forecast_backlog",
    with_frames(
        "forecasts predictions",
        """SELECT coalesce(f.w, a.w) AS window_start, coalesce(f.n, 0) AS forecasts, coalesce(a.n, 0) AS anomalies
           FROM (SELECT date_trunc('hour', created_at)::TIMESTAMP AS w, count(*) AS n FROM forecasts GROUP BY 1) f
           FULL JOIN (SELECT date_trunc('hour', created_at)::TIMESTAMP AS w, count(*) AS n FROM predictions
                      WHERE anomaly_detected GROUP BY 1) a ON f.w = a.w
           WHERE coalesce(f.n, 0) < coalesce(a.n, 0) * 0.8""",
    ),
)
def forecast_backlog(spark, sf_dir):
    anomalies = S.predictions(spark, sf_dir).where("anomaly_detected")
    return L.forecast_backlog(S.forecasts(spark, sf_dir), anomalies, share=0.8)


@query(
    "extraction_lag",
    with_frames(
        "signals located_features",
        f"""SELECT s.equipment_id, s.last_signal_at, f.last_feature_at,
                   {r6('(epoch_us(s.last_signal_at) - epoch_us(f.last_feature_at)) / 1e6')} AS lag_seconds
            FROM (SELECT equipment_id, max(recorded_at) AS last_signal_at FROM signals GROUP BY 1) s
            LEFT JOIN (SELECT equipment_id, max(window_start) AS last_feature_at FROM located_features GROUP BY 1) f
                USING (equipment_id)
            WHERE f.last_feature_at IS NULL OR (epoch_us(s.last_signal_at) - epoch_us(f.last_feature_at)) / 1e6 > 1800""",
    ),
)
def extraction_lag(spark, sf_dir):
    located = R.locate_features(S.features(spark, sf_dir), S.signals(spark, sf_dir), ["window_start"])
    return L.extraction_lag(S.signals(spark, sf_dir), located)


@query(
    "histogram",
    with_frames(
        "durations",
        "SELECT task_name, observations, total, le, bucket FROM ("
        + " UNION ALL ".join(
            f"""SELECT task_name, count(seconds) AS observations, {r6('sum(seconds)')} AS total, {le} AS le,
                       count(*) FILTER (seconds <= {bound}) AS bucket FROM durations GROUP BY 1"""
            for le, bound in [(f"{b}::DOUBLE", b) for b in L.DURATION_BUCKETS] + [("NULL", "'inf'::DOUBLE")]
        )
        + ")",
    ),
)
def histogram(spark, sf_dir):
    return L.histogram(S.durations(spark, sf_dir), "seconds", ["task_name"])


TASKS = """
tasks AS (
    SELECT id AS task_id, task_name, equipment_id AS worker, 'start' AS kind, NULL AS state, ts FROM durations
    UNION ALL
    SELECT id, task_name, equipment_id, 'finish', CASE WHEN seconds > 100 THEN 'FAILURE' ELSE 'SUCCESS' END,
           ts + to_microseconds(round(seconds * 1000000)::BIGINT)
    FROM durations WHERE seconds <= 300),"""


def _tasks(spark, sf_dir):
    rows = S.durations(spark, sf_dir)
    base = [F.col("id").alias("task_id"), "task_name", F.col("equipment_id").alias("worker")]
    started = rows.select(*base, F.lit("start").alias("kind"), F.lit(None).cast("string").alias("state"), "ts")
    state = F.when(F.col("seconds") > 100, "FAILURE").otherwise("SUCCESS")
    micros = F.round(F.col("seconds") * 1000000).cast("bigint")
    done = F.timestamp_add("MICROSECOND", micros, F.col("ts")).cast("timestamp_ntz")
    finished = rows.where(F.col("seconds") <= 300).select(
        *base, F.lit("finish").alias("kind"), state.alias("state"), done.alias("ts")
    )
    return started.unionByName(finished)


@query(
    "task_metrics",
    with_frames(
        "durations",
        f"""SELECT task_name, coalesce(f.state, 'running') AS status, count(*) AS tasks, {r6('avg(d)')} AS mean_seconds,
                   {r6('max(d)')} AS max_seconds, count(*) FILTER (d > 60) AS slow_tasks
            FROM (SELECT s.task_name, f.state, (epoch_us(f.ts) - epoch_us(s.ts)) / 1e6 AS d
                  FROM (SELECT * FROM tasks WHERE kind = 'start') s
                  LEFT JOIN (SELECT * FROM tasks WHERE kind = 'finish') f USING (task_id)) f
            GROUP BY 1, 2""",
        TASKS,
    ),
)
def task_metrics(spark, sf_dir):
    return L.task_metrics(L.task_durations(_tasks(spark, sf_dir)))


@query(
    "active_tasks",
    with_frames(
        "durations",
        """SELECT task_id, worker, kind, ts,
                  sum(step) OVER (PARTITION BY worker ORDER BY ts, step, task_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active_tasks
           FROM (SELECT *, CASE WHEN kind = 'start' THEN 1 ELSE -1 END AS step FROM tasks)""",
        TASKS,
    ),
)
def active_tasks(spark, sf_dir):
    return L.active_tasks(_tasks(spark, sf_dir)).select("task_id", "worker", "kind", "ts", "active_tasks")
