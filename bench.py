"""Times the registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from motorlens.plans import catalog
from motorlens.session import drop_tables, local_session

HEADLINE = [
    "window_statistics", "median_filter", "assemble_features", "averaged_spectrum", "spectral_peaks", "extract_features",
    "parse_rows", "chunk_signals", "load_stats", "read_recordings", "decode_signal_blobs", "upsert_features",
    "resolve_equipment", "validation_issues", "constraint_violations", "features_analysis", "predictions_detailed",
    "equipment_summary", "rms_trends", "anomaly_analysis", "system_health", "dashboard_summary", "equipment_health",
    "list_anomalies", "daily_report", "rms_zscore_anomalies", "diagnostic_report_rows", "apply_retention",
    "audit_hourly", "suspicious_activity", "verify_integrity", "classify_requests", "p95_alert", "sustained", "active_tasks",
    "histogram", "regularise", "replace_outliers", "ar_fleet", "seasonal_trend_fleet", "forecast_fleet", "column_quantiles",
    "robust_scale", "pca", "isolation_forest", "dbscan", "train_anomaly_models", "stream_hourly_rms", "stream_suspicious",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(catalog.QUERIES)
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    # start the session's workers before anything is timed
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        # as a user runs it, without the rounding that comparisons need
        catalog.QUERIES[name].unrounded(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        drop_tables(spark)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total query time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
