"""Cutting recordings into overlapping windows, cleaning them and computing statistics.

Input ``samples`` rows are ``(signal_id, phase, sample_idx, value)`` with dense,
zero-based indices.  The unit of parallelism is one window of one signal, never
a signal: after the spread everything is clustered by ``(signal_id, window_no)``,
so cleaning, statistics and the wide row share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.clock import plus_microseconds
from motorlens.functions.expressions import PHASES, STATS, as_column
from motorlens.session import materialise

WINDOW = ["signal_id", "window_no"]
SEGMENT = ["signal_id", "window_no", "phase"]

# fixed values of the feature extraction
WINDOW_MS = 1000
OVERLAP = 0.5
SPECTRUM_SIZE = 4096
MIN_CLEAN_LENGTH = 100
MAX_MISSING = 0.2
MEDIAN_KERNEL = 51


def window_size(rate: Column | str, length: Column | str, window_ms: int = WINDOW_MS) -> Column:
    """Samples per window, raised to the spectrum size when the recording is long enough."""
    size = F.floor(F.lit(window_ms) * as_column(rate) / 1000).cast("bigint")
    long_enough = as_column(length) >= SPECTRUM_SIZE
    return F.when((size < SPECTRUM_SIZE) & long_enough, F.lit(SPECTRUM_SIZE).cast("bigint")).otherwise(size)


def window_hop(size: Column | str, overlap: float = OVERLAP) -> Column:
    return F.floor(as_column(size) * (1.0 - overlap)).cast("bigint")


def _sized(samples: DataFrame, size: int | str, hop: int | str) -> DataFrame:
    def column(value: int | str) -> Column:
        return F.col(value) if isinstance(value, str) else F.lit(value).cast("bigint")

    return samples.withColumn("_size", column(size)).withColumn("_hop", column(hop))


def spread_over_windows(samples: DataFrame, size: int | str, hop: int | str) -> DataFrame:
    """One row per sample and window that covers it; incomplete windows are still in."""
    first = F.expr("greatest(0L, (sample_idx - _size + _hop) div _hop)")
    last = F.expr("sample_idx div _hop")
    return _sized(samples, size, hop).withColumn("window_no", F.explode(F.sequence(first, last)))


def _is_complete(last_index: Column) -> Column:
    # Indices are dense, so a window is full exactly when some phase reaches its last index.
    # Window 0 of a recording shorter than one window stands for the whole recording.
    return (F.col("window_no") == 0) | (last_index == F.col("window_no") * F.col("_hop") + F.col("_size") - 1)


def sliding_windows(samples: DataFrame, size: int | str, hop: int | str) -> DataFrame:
    """Samples of every full window; a short recording is one window of its whole length."""
    spread = spread_over_windows(samples, size, hop).repartition(*WINDOW)
    reach = F.max("sample_idx").over(Window.partitionBy(*WINDOW))
    return spread.withColumn("_reach", reach).where(_is_complete(F.col("_reach"))).drop("_reach", "_size", "_hop")


def window_times(
    windows: DataFrame, size: int, hop: int, recorded_at: str = "recorded_at", rate: str = "sample_rate_hz",
    length: str = "samples_count", window_ms: int = WINDOW_MS,
) -> DataFrame:
    """Start and end of a window; a short recording ends ``window_ms`` after its start."""
    sized = windows.select("*", F.lit(size).cast("bigint").alias("_size"), F.lit(hop).cast("bigint").alias("_hop"))
    return _timed(sized, recorded_at, rate, F.col(length) < F.col("_size"), window_ms).drop("_size", "_hop")


def _timed(df: DataFrame, recorded_at: str, rate: str, short: Column, window_ms: int) -> DataFrame:
    def offset(samples: Column) -> Column:
        return F.round(samples * 1_000_000 / F.col(rate)).cast("bigint")

    first = F.col("window_no") * F.col("_hop")
    end = F.when(short, F.lit(window_ms * 1000).cast("bigint")).otherwise(offset(first + F.col("_size")))
    return df.withColumn("window_start", plus_microseconds(recorded_at, offset(first))).withColumn(
        "window_end", plus_microseconds(recorded_at, end)
    )


def missing_gate(windows: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """Drop a (window, phase) whose missing share is strictly above the limit; adds the two counts."""
    segment = Window.partitionBy(*SEGMENT)
    counted = windows.withColumn("raw_count", F.count(F.lit(1)).over(segment)).withColumn(
        "missing_count", F.count_if(F.col("value").isNull()).over(segment)
    )
    return counted.where(F.col("missing_count") / F.col("raw_count") <= max_missing)


def trim_missing(gated: DataFrame, min_length: int = MIN_CLEAN_LENGTH) -> DataFrame:
    """Cut leading and trailing gaps.  A segment without gaps is exempt from the length rule."""
    segment = Window.partitionBy(*SEGMENT)
    known = F.when(F.col("value").isNotNull(), F.col("sample_idx"))
    edged = gated.withColumn("_lo", F.min(known).over(segment)).withColumn("_hi", F.max(known).over(segment))
    long_enough = (F.col("missing_count") == 0) | (F.col("_hi") - F.col("_lo") + 1 >= min_length)
    inside = F.col("sample_idx").between(F.col("_lo"), F.col("_hi"))
    return edged.where(inside & long_enough).drop("_lo", "_hi")


def fill_linear(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Fill NULLs between two known neighbours on the straight line; outer gaps stay NULL."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("i"), F.col(value).alias("v")))
    running = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*keys).orderBy(position).rowsBetween(*running)
    down = Window.partitionBy(*keys).orderBy(F.col(position).desc()).rowsBetween(*running)
    around = df.withColumn("_next", F.last(known, ignorenulls=True).over(down)).withColumn(
        "_prev", F.last(known, ignorenulls=True).over(up)
    )
    share = (F.col(position) - F.col("_prev.i")) / F.nullif(F.col("_next.i") - F.col("_prev.i"), F.lit(0))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    return around.withColumn(value, F.coalesce(F.col(value), line)).drop("_next", "_prev")


def interpolate_gaps(trimmed: DataFrame) -> DataFrame:
    """Fill inner gaps of a trimmed segment; both neighbours always exist there."""
    return fill_linear(trimmed, SEGMENT, "sample_idx", "value")


def median_filter(filled: DataFrame, kernel: int = MEDIAN_KERNEL) -> DataFrame:
    """Running median, zero-padded at the edges, for segments that had gaps and are long enough."""
    half = kernel // 2
    needed = F.col("missing_count") > 0
    frame = Window.partitionBy(*SEGMENT).orderBy("sample_idx").rowsBetween(-half, half)
    segment = Window.partitionBy(*SEGMENT)
    around = F.collect_list(F.when(needed, F.col("value"))).over(frame)
    padded = F.sort_array(F.concat(F.col("_around"), F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size("_around"))))
    applies = needed & (F.count(F.lit(1)).over(segment) >= kernel)
    return (
        filled.withColumn("_around", around)
        .withColumn("_applies", applies)
        .withColumn("value", F.when(F.col("_applies"), padded[half]).otherwise(F.col("value")))
        .drop("_around", "_applies")
    )


def clean_windows(
    windows: DataFrame, max_missing: float = MAX_MISSING, min_length: int = MIN_CLEAN_LENGTH,
    kernel: int = MEDIAN_KERNEL,
) -> DataFrame:
    """Gate, trim, interpolate and filter every (window, phase), in this order."""
    return median_filter(interpolate_gaps(trim_missing(missing_gate(windows, max_missing), min_length)), kernel)


def statistic_columns() -> list[Column]:
    """The eight statistics of one segment, NULL values ignored."""
    v = F.col("value")
    rms = F.sqrt(F.avg(v * v))
    peak = F.greatest(F.abs(F.min(v)), F.abs(F.max(v)))
    return [
        rms.alias("rms"),
        F.when(rms > 0, peak / rms).when(rms == 0, F.lit(0.0)).alias("crest"),
        F.kurtosis(v).alias("kurt"),
        F.skewness(v).alias("skew"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def stat_features(windows: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Long statistics, one row per segment."""
    return windows.groupBy(*keys).agg(*statistic_columns())


def assemble_features(stats: DataFrame, keys: list[str] = WINDOW, extras: dict[str, Column] | None = None) -> DataFrame:
    """Three phase rows into one wide row; a window with no phase does not appear."""
    wide = [
        F.max(F.when(F.col("phase") == phase, F.col(stat))).alias(f"{stat}_{phase}") for stat in STATS for phase in PHASES
    ]
    more = [column.alias(name) for name, column in (extras or {}).items()]
    return stats.groupBy(*keys).agg(*wide, *more)


def window_statistics(samples: DataFrame, size: int | str, hop: int | str) -> DataFrame:
    """Wide statistics straight from gap-tolerant samples, without the cleaning steps.

    Only mergeable aggregates are used, so map tasks already reduce their samples
    and the shuffle carries one partial row per window and phase.
    """
    spread = spread_over_windows(samples, size, hop)
    keys = [*SEGMENT, "_size", "_hop"]
    stats = spread.groupBy(*keys).agg(*statistic_columns(), F.max("sample_idx").alias("_reach"))
    wide = assemble_features(stats, [*WINDOW, "_size", "_hop"], {"_reach": F.max("_reach")})
    return wide.where(_is_complete(F.col("_reach"))).drop("_reach", "_size", "_hop")


def phase_comparison(features: DataFrame, keys: list[str]) -> DataFrame:
    """Wide features to ``(metric, phase, value)`` rows for the four headline statistics, missing as 0."""
    metrics = ("rms", "crest", "kurt", "skew")
    entries = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(phase).alias("phase"),
                F.coalesce(F.col(f"{metric}_{phase}"), F.lit(0.0)).alias("value"),
            )
            for metric in metrics
            for phase in PHASES
        ]
    )
    return features.select(*keys, F.inline(entries))


def slice_samples(samples: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    """Samples ``start .. end-1``, then every ``step``-th of them."""
    index = F.col("sample_idx")
    return samples.where((index >= start) & (index < end) & (F.pmod(index - start, F.lit(step)) == 0))


def preview(samples: DataFrame, points: int) -> DataFrame:
    """At most ``points`` evenly thinned samples per segment: every k-th with k = max(1, count div points).

    The count is the longest phase of the recording, as stored with the signal.
    """
    # stored, so that its size is known and a hot signal's samples can be split in the join
    counts = materialise(samples.groupBy("signal_id").agg((F.max("sample_idx") + 1).alias("_n")))
    step = F.greatest(F.lit(1).cast("bigint"), F.expr(f"_n div {points}"))
    thinned = samples.join(counts, "signal_id").withColumn("factor", step)
    index = F.col("sample_idx")
    return thinned.where((F.pmod(index, F.col("factor")) == 0) & (index < F.col("factor") * points)).drop("_n")


def preview_statistics(samples: DataFrame, points: int) -> DataFrame:
    v = F.col("value")
    return (
        preview(samples, points)
        .groupBy("signal_id", "phase")
        .agg(
            F.count(F.lit(1)).alias("samples_count"),
            F.first("factor").alias("downsample_factor"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
    )


def time_axis(samples: DataFrame, rate: int) -> DataFrame:
    """Seconds from 0 to N/rate inclusive over the N points of a segment."""
    counts = materialise(samples.groupBy("signal_id", "phase").agg(F.count(F.lit(1)).alias("_n")))
    step = F.try_divide(F.col("_n") / F.lit(float(rate)), F.col("_n") - 1)
    seconds = F.coalesce(F.col("sample_idx") * step, F.lit(0.0))
    return samples.join(counts, ["signal_id", "phase"]).withColumn("seconds", seconds).drop("_n")
