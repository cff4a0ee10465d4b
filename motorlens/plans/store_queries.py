"""Registered queries: stored tables changed and read in parts, chained streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.operators import audit as A
from motorlens.operators import ingest as I
from motorlens.operators import stores as W
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.plans.stream_queries import _collected
from motorlens.session import table_folder
from motorlens.sources import star_tables as S
from motorlens.streaming import rules as U

# parts of the year in which readings arrive, the last one late, and from when they are kept
CUTS = ["2024-01-10", "2024-01-20"]
KEPT_FROM = "2024-01-05 06:00:00"


@query(
    "refresh_changed",
    with_frames(
        "readings",
        f"""SELECT equipment_id, count(*) AS readings, {r6('avg(value)')} AS mean_rms, {r6('stddev_pop(value)')} AS std_rms,
                   {r6('min(value)')} AS min_rms, {r6('max(value)')} AS max_rms, min(date_trunc('hour', ts))::TIMESTAMP AS first_hour,
                   max(date_trunc('hour', ts))::TIMESTAMP AS last_hour
            FROM readings WHERE value IS NOT NULL AND date_trunc('hour', ts) >= TIMESTAMP '{KEPT_FROM}' GROUP BY 1""",
    ),
)
def refresh_changed(spark, sf_dir):
    """Three batches of all readings, one of them late and one repeated, then retention."""
    readings, ts = S.readings(spark, sf_dir).select("equipment_id", "ts", "value"), F.col("ts")
    first, second = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    store = table_folder(spark)
    W.refresh_changed(spark, store, readings.where((ts >= first) & (ts < second)), 0)
    W.refresh_changed(spark, store, readings.where(ts >= second), 1)
    W.refresh_changed(spark, store, readings.where(ts < first), 2)
    W.refresh_changed(spark, store, readings.where(ts < first), 2, keep_from=KEPT_FROM)
    return W.stored_summary(spark, store).drop("bucket")


@query(
    "upsert_stored",
    with_frames(
        "features",
        f"""SELECT raw_id, window_start, window_end, 1::BIGINT AS n, min(id) AS first_id, {r6('arg_min(rms_a, id)')} AS rms_a
            FROM features WHERE window_end > window_start GROUP BY 1, 2, 3""",
    ),
)
def upsert_stored(spark, sf_dir):
    """Older features, then newer ones that overlap them by a year, into one store by month."""
    features = S.features(spark, sf_dir)
    path = f"{table_folder(spark)}/features"
    W.upsert_stored(features.where(F.col("window_start") < F.lit("1999-01-01").cast("timestamp_ntz")), path, "month")
    W.upsert_stored(features.where(F.col("window_start") >= F.lit("1998-01-01").cast("timestamp_ntz")), path, "month")
    return spark.read.parquet(path).groupBy(*I.WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.sum("rms_a").alias("rms_a"))


@query(
    "seek_audit_page",
    with_frames(
        "audit",
        """SELECT id, user_id, username, user_role, action_type, result, endpoint, request_ip, ts FROM audit
           ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 2000""",
    ),
)
def seek_audit_page(spark, sf_dir):
    """A page of the whole audit log behind the last row of the page before."""
    rows, keys = S.audit(spark, sf_dir), [("ts", True), ("id", True)]
    path = table_folder(spark)
    W.store_sorted(rows, keys, path, parts=16)
    last = A.audit_page(rows, page=40).orderBy("ts", "id").first()
    if last is None:
        # the log ends before that page
        return rows.limit(0).drop("integrity_hash")
    return W.page_after(spark, path, keys, last.asDict(), 50).drop("integrity_hash")


@query(
    "stream_forecast_backlog",
    with_frames(
        "forecasts predictions",
        """SELECT coalesce(f.w, a.w) AS window_start, coalesce(f.n, 0) AS forecasts, coalesce(a.n, 0) AS anomalies
           FROM (SELECT date_trunc('hour', created_at)::TIMESTAMP AS w, count(*) AS n FROM forecasts GROUP BY 1) f
           FULL JOIN (SELECT date_trunc('hour', created_at)::TIMESTAMP AS w, count(*) AS n FROM predictions
                      WHERE anomaly_detected GROUP BY 1) a ON f.w = a.w
           WHERE coalesce(f.n, 0) < coalesce(a.n, 0) * 0.8 AND coalesce(f.w, a.w) + INTERVAL 1 HOUR < (
               SELECT least((SELECT max(created_at) FROM forecasts), (SELECT max(created_at) FROM predictions WHERE anomaly_detected))
                      - INTERVAL 10 MINUTE)""",
    ),
)
def stream_forecast_backlog(spark, sf_dir):
    """Hours with too few forecasts, from two streams counted by hour and joined."""
    folder = table_folder(spark)

    def stream(name, rows):
        rows.write.parquet(f"{folder}/{name}")
        return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")

    forecasts = stream("forecasts", S.forecasts(spark, sf_dir).select("created_at"))
    anomalies = stream("anomalies", S.predictions(spark, sf_dir).where("anomaly_detected").select("created_at"))
    table = _collected(spark, U.stream_forecast_backlog(forecasts, anomalies, share=0.8))
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
