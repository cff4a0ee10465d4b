"""Registered queries: windows, cleaning, statistics, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS, PHASES, STATS
from motorlens.operators import windows as W
from motorlens.plans.registry import query
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.sources import star_tables as S

SIZE, HOP, RATE = 32, 16, 1000
MIN_LENGTH, KERNEL = 16, 5

SPREAD = f"""
spread AS (
    SELECT s.*, w.window_no
    FROM samples s, LATERAL (SELECT unnest(range(greatest(0, (s.sample_idx - {SIZE} + {HOP}) // {HOP}),
                                                 s.sample_idx // {HOP} + 1)) AS window_no) w),
lengths AS (SELECT signal_id, max(sample_idx) + 1 AS n FROM samples GROUP BY signal_id),
windowed AS (
    SELECT spread.* FROM spread JOIN lengths USING (signal_id)
    WHERE window_no = 0 OR window_no * {HOP} + {SIZE} <= n),"""

GATED = f"""
gated AS (
    SELECT * FROM (
        SELECT *, count(*) OVER seg AS raw_count, count(*) FILTER (value IS NULL) OVER seg AS missing_count
        FROM windowed WINDOW seg AS (PARTITION BY signal_id, window_no, phase))
    WHERE missing_count / raw_count <= 0.2),"""

TRIMMED = f"""
trimmed AS (
    SELECT * EXCLUDE (lo, hi) FROM (
        SELECT *, min(sample_idx) FILTER (value IS NOT NULL) OVER seg AS lo,
                  max(sample_idx) FILTER (value IS NOT NULL) OVER seg AS hi
        FROM gated WINDOW seg AS (PARTITION BY signal_id, window_no, phase))
    WHERE sample_idx BETWEEN lo AND hi AND (missing_count = 0 OR hi - lo + 1 >= {MIN_LENGTH})),"""

FILLED = """
neighbours AS (
    SELECT *, last_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER up AS pi,
              last_value(value IGNORE NULLS) OVER up AS pv,
              first_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER ahead AS ni,
              first_value(value IGNORE NULLS) OVER ahead AS nv
    FROM trimmed
    WINDOW up AS (PARTITION BY signal_id, window_no, phase ORDER BY sample_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           ahead AS (PARTITION BY signal_id, window_no, phase ORDER BY sample_idx
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
    SELECT signal_id, equipment_id, phase, sample_idx, window_no, raw_count, missing_count,
           coalesce(value, pv + (nv - pv) * ((sample_idx - pi) / nullif(ni - pi, 0))) AS value
    FROM neighbours),"""

HALF = KERNEL // 2
SMOOTHED = f"""
smoothed AS (
    SELECT * EXCLUDE (around, n, value),
           CASE WHEN missing_count > 0 AND n >= {KERNEL}
                THEN list_sort(list_concat(around, list_resize([]::DOUBLE[], {KERNEL} - len(around), 0.0)))[{HALF + 1}]
                ELSE value END AS value
    FROM (SELECT *, list(value) OVER (PARTITION BY signal_id, window_no, phase ORDER BY sample_idx
                                      ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS around,
                 count(*) OVER (PARTITION BY signal_id, window_no, phase) AS n
          FROM filled)),"""

CLEAN = SPREAD + GATED + TRIMMED + FILLED + SMOOTHED


def stats_sql(source: str, keys: str = "signal_id, window_no, phase") -> str:
    return f"""
    SELECT {keys}, {', '.join(f'{STAT_SQL[s]} AS "{s}"' for s in STATS)}
    FROM (SELECT *, value - avg(value) OVER (PARTITION BY {keys}) AS dev FROM {source}) GROUP BY {keys}"""


STAT_SQL = {
    "rms": "sqrt(avg(value * value))",
    "crest": "CASE WHEN sqrt(avg(value * value)) > 0 THEN greatest(abs(min(value)), abs(max(value))) "
    "/ sqrt(avg(value * value)) WHEN sqrt(avg(value * value)) = 0 THEN 0 END",
    "kurt": "avg(dev ** 4) / nullif(avg(dev ** 2) ** 2, 0) - 3",
    "skew": "avg(dev ** 3) / nullif(avg(dev ** 2) ** 1.5, 0)",
    "mean": "avg(value)",
    "std": "stddev_pop(value)",
    "min": "min(value)",
    "max": "max(value)",
}


def wide_sql(source: str) -> str:
    columns = ",\n".join(
        r6(f"max(\"{s}\") FILTER (phase = '{p}')") + f" AS {s}_{p}" for s in STATS for p in PHASES
    )
    return f"SELECT signal_id, window_no, {columns} FROM {source} GROUP BY signal_id, window_no"


@query(
    "sliding_windows",
    with_frames("samples", "SELECT signal_id, phase, sample_idx, window_no, round(value, 6) + 0.0 AS value FROM windowed", SPREAD),
)
def sliding_windows(spark, sf_dir):
    return W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP).select(
        "signal_id", "phase", "sample_idx", "window_no", "value"
    )


def _signal_windows(spark, sf_dir):
    samples = S.samples(spark, sf_dir)
    windows = W.sliding_windows(samples, SIZE, HOP).select(*W.WINDOW).distinct()
    return windows.withColumn("recorded_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn(
        "sample_rate_hz", F.lit(RATE)
    )


@query(
    "window_times",
    with_frames(
        "samples",
        f"""SELECT DISTINCT signal_id, window_no,
              TIMESTAMP '2024-01-01' + to_microseconds(window_no * {HOP} * 1000000 // {RATE}) AS window_start,
              TIMESTAMP '2024-01-01' + CASE WHEN n < {SIZE} THEN INTERVAL 1 SECOND
                  ELSE to_microseconds((window_no * {HOP} + {SIZE}) * 1000000 // {RATE}) END AS window_end
        FROM windowed JOIN lengths USING (signal_id)""",
        SPREAD,
    ),
)
def window_times(spark, sf_dir):
    samples = S.samples(spark, sf_dir)
    lengths = samples.groupBy("signal_id").agg((F.max("sample_idx") + 1).alias("samples_count"))
    windows = _signal_windows(spark, sf_dir).join(lengths, "signal_id")
    return W.window_times(windows, SIZE, HOP).select("signal_id", "window_no", "window_start", "window_end")


@query(
    "missing_gate",
    with_frames(
        "samples",
        "SELECT DISTINCT signal_id, window_no, phase, raw_count, missing_count FROM gated",
        SPREAD + GATED,
    ),
)
def missing_gate(spark, sf_dir):
    gated = W.missing_gate(W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP))
    return gated.select(*W.SEGMENT, "raw_count", "missing_count").distinct()


def _sample_rows(df):
    return df.select(*W.SEGMENT, "sample_idx", "value")


SAMPLE_ROWS = "SELECT signal_id, window_no, phase, sample_idx, round(value, 6) + 0.0 AS value FROM "


@query("trim_missing", with_frames("samples", SAMPLE_ROWS + "trimmed", SPREAD + GATED + TRIMMED))
def trim_missing(spark, sf_dir):
    gated = W.missing_gate(W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP))
    return _sample_rows(W.trim_missing(gated, MIN_LENGTH))


@query("interpolate_gaps", with_frames("samples", SAMPLE_ROWS + "filled", SPREAD + GATED + TRIMMED + FILLED))
def interpolate_gaps(spark, sf_dir):
    gated = W.missing_gate(W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP))
    return _sample_rows(W.interpolate_gaps(W.trim_missing(gated, MIN_LENGTH)))


@query("median_filter", with_frames("samples", SAMPLE_ROWS + "smoothed", CLEAN))
def median_filter(spark, sf_dir):
    windows = W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP)
    return _sample_rows(W.clean_windows(windows, min_length=MIN_LENGTH, kernel=KERNEL))


LONG_STATS = ", ".join(f'{r6(chr(34) + s + chr(34))} AS "{s}"' for s in STATS)


@query(
    "stat_features",
    with_frames(
        "samples",
        f"SELECT signal_id, window_no, phase, {LONG_STATS} FROM stats",
        CLEAN + f"stats AS ({stats_sql('smoothed')}),",
    ),
)
def stat_features(spark, sf_dir):
    windows = W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP)
    return W.stat_features(W.clean_windows(windows, min_length=MIN_LENGTH, kernel=KERNEL))


@query(
    "window_statistics",
    with_frames("samples", wide_sql("stats"), SPREAD + f"stats AS ({stats_sql('windowed')}),"),
)
def window_statistics(spark, sf_dir):
    return W.window_statistics(S.samples(spark, sf_dir), SIZE, HOP)


@query("assemble_features", with_frames("samples", wide_sql("stats"), CLEAN + f"stats AS ({stats_sql('smoothed')}),"))
def assemble_features(spark, sf_dir):
    windows = W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP)
    return W.assemble_features(W.stat_features(W.clean_windows(windows, min_length=MIN_LENGTH, kernel=KERNEL)))


@query(
    "slice_samples",
    with_frames(
        "samples",
        "SELECT signal_id, phase, sample_idx, round(value, 6) + 0.0 AS value FROM samples "
        "WHERE sample_idx >= 10 AND sample_idx < 300 AND (sample_idx - 10) % 3 = 0",
    ),
)
def slice_samples(spark, sf_dir):
    return W.slice_samples(S.samples(spark, sf_dir), 10, 300, 3).select("signal_id", "phase", "sample_idx", "value")


@query(
    "preview",
    with_frames(
        "samples",
        f"""SELECT signal_id, phase, count(*) AS samples_count, max(k) AS downsample_factor, {r6('avg(value)')} AS mean,
                   {r6('stddev_pop(value)')} AS std, {r6('min(value)')} AS "min", {r6('max(value)')} AS "max"
            FROM (SELECT s.*, k FROM samples s
                  JOIN (SELECT signal_id, greatest(1, (max(sample_idx) + 1) // 100) AS k FROM samples GROUP BY 1) l
                  USING (signal_id))
            WHERE sample_idx % k = 0 AND sample_idx // k < 100 GROUP BY signal_id, phase""",
    ),
)
def preview(spark, sf_dir):
    return W.preview_statistics(S.samples(spark, sf_dir), 100)


@query(
    "time_axis",
    with_frames(
        "samples",
        f"""SELECT signal_id, phase, sample_idx,
                   round(coalesce(sample_idx * ((n / {RATE}.0::DOUBLE) / nullif(n - 1, 0)), 0) * 1e6, 3) AS microseconds
            FROM (SELECT *, count(*) OVER (PARTITION BY signal_id, phase) AS n FROM samples)""",
    ),
)
def time_axis(spark, sf_dir):
    return W.time_axis(S.samples(spark, sf_dir), RATE).select(
        "signal_id", "phase", "sample_idx", F.round(F.col("seconds") * 1e6, 3).alias("microseconds")
    )


@query(
    "phase_comparison",
    with_frames(
        "features",
        f"""SELECT metric, phase, count(*) AS n, {r6('avg(value)')} AS mean, {r6('min(value)')} AS low,
                   {r6('max(value)')} AS high
            FROM ({' UNION ALL '.join(
                f"SELECT '{m}' AS metric, '{p}' AS phase, coalesce({m}_{p}, 0) AS value FROM features"
                for m in ("rms", "crest", "kurt", "skew")
                for p in PHASES
            )}) GROUP BY metric, phase""",
    ),
)
def phase_comparison(spark, sf_dir):
    """The long rows, summarised per metric and phase so that the result stays small."""
    rows = W.phase_comparison(S.features(spark, sf_dir), ["id"])
    return rows.groupBy("metric", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )
