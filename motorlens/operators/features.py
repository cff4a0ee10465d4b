"""The whole chain from samples to stored feature rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from motorlens.functions import spectra as K
from motorlens.functions.expressions import PHASES, STATS
from motorlens.functions.shipping import by_value
from motorlens.operators import spectrum as P
from motorlens.operators import windows as W
from motorlens.operators.windows import SEGMENT, WINDOW, _is_complete, _timed

by_value(__name__)

SIGNAL_COLUMNS = ["recorded_at", "sample_rate_hz"]


def samples_from_chunks(signals: DataFrame) -> DataFrame:
    """Stored chunks (``phase_a/b/c`` arrays, ``chunk_no``) as long samples that carry their signal's attributes.

    Attributes travel with the rows, so no join back to the signals is needed.
    """
    phases = F.array(
        *[F.struct(F.lit(p).alias("phase"), F.col(f"phase_{p}").alias("values")) for p in PHASES]
    )
    long = signals.select(
        "signal_id", "samples_count", *SIGNAL_COLUMNS, "first_idx", F.inline(phases)
    ).where(F.col("values").isNotNull())
    return long.select(
        "signal_id", "samples_count", *SIGNAL_COLUMNS, "phase", "first_idx", F.posexplode("values").alias("_i", "value")
    ).select(
        "signal_id", "phase", (F.col("first_idx") + F.col("_i")).alias("sample_idx"),
        F.col("value").cast("double").alias("value"), "samples_count", *SIGNAL_COLUMNS,
    )


def extract_features(
    samples: DataFrame, size: int | None = None, hop: int | None = None, window_ms: int = W.WINDOW_MS,
    overlap: float = W.OVERLAP, min_length: int = W.MIN_CLEAN_LENGTH, kernel: int = W.MEDIAN_KERNEL,
    max_missing: float = W.MAX_MISSING, spectrum_size: int = W.SPECTRUM_SIZE, parts: int | None = None,
) -> DataFrame:
    """Windows, cleaning, statistics, spectra and window times for all recordings at once.

    ``samples`` carries ``sample_rate_hz`` and ``recorded_at``; without an explicit
    ``size`` it also carries ``samples_count`` and every signal gets the window its
    own rate and length ask for.  One exchange on ``(signal_id, window_no)`` feeds
    the whole chain, in ``parts`` tasks where the caller knows how many the samples need.
    """
    if size is None:
        samples = samples.withColumn("_want", W.window_size("sample_rate_hz", "samples_count", window_ms))
        samples = samples.withColumn("_step", W.window_hop("_want", overlap))
        spread = W.spread_over_windows(samples, "_want", "_step").drop("_want", "_step")
    else:
        spread = W.spread_over_windows(samples, size, hop or int(size * (1 - overlap)))
    carried = [*SIGNAL_COLUMNS, "_size", "_hop", "_reach"]
    spread = spread.repartition(parts, *WINDOW) if parts else spread.repartition(*WINDOW)
    reach = F.max("sample_idx").over(W.Window.partitionBy(*WINDOW))
    complete = spread.withColumn("_reach", reach).where(_is_complete(F.col("_reach")))
    cleaned = W.clean_windows(complete, max_missing, min_length, kernel)
    # statistics and the ordered array come out of the same grouping
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    segments = cleaned.groupBy(*SEGMENT).agg(
        *W.statistic_columns(),
        F.transform(ordered, lambda s: s["value"]).alias("segment"),
        F.max("missing_count").alias("missing_count"),
        F.max("raw_count").alias("raw_count"),
        *[F.first(name).alias(name) for name in carried],
    )
    return _wide_rows(P.describe_spectrum(segments, size=spectrum_size), carried, window_ms)


def _wide_rows(described: DataFrame, carried: list[str], window_ms: int) -> DataFrame:
    """Cleaned segments with their statistics and spectra to one row per window with times."""
    packed = F.when(
        F.col("peaks").isNotNull(),
        F.struct(
            "peaks",
            F.col("centroid").alias("spectral_centroid"),
            F.col("bandwidth").alias("spectral_bandwidth"),
            F.col("rolloff").alias("spectral_rolloff"),
            F.col("energy").alias("spectral_energy"),
            "dominant_frequency",
            F.col("sample_rate_hz").alias("sample_rate"),
        ),
    )

    def of(phase, column, name):
        return F.max(F.when(F.col("phase") == phase, column)).alias(name)

    wide = described.groupBy(*WINDOW).agg(
        *[of(p, F.col(stat), f"{stat}_{p}") for stat in STATS for p in PHASES],
        *[of(p, packed, f"phase_{p}") for p in PHASES],
        *[of(p, F.col("missing_count") / F.col("raw_count"), f"missing_ratio_{p}") for p in PHASES],
        *[of(p, F.col("n_samples"), f"clean_length_{p}") for p in PHASES],
        F.count(F.lit(1)).alias("processed_phases"),
        *[F.max(name).alias(name) for name in carried],
    )
    short = F.col("_reach") < F.col("_size") - 1
    timed = _timed(wide, "recorded_at", "sample_rate_hz", short, window_ms)
    return timed.drop(*carried)


def window_slices(chunks: DataFrame, size: int | None, hop: int | None, window_ms: int = W.WINDOW_MS, overlap: float = W.OVERLAP) -> DataFrame:
    """The part of every chunk's arrays that each window covers: ``(signal_id, window_no, phase, at, part)`` and the carried columns.

    A window gets one row per phase and chunk it touches, never one per sample; values
    stay as narrow as they are stored.
    """
    if size is None:
        sized = chunks.withColumn("_size", W.window_size("sample_rate_hz", "samples_count", window_ms))
        sized = sized.withColumn("_hop", W.window_hop("_size", overlap))
    else:
        hop = hop or int(size * (1 - overlap))
        sized = chunks.withColumn("_size", F.lit(size).cast("bigint")).withColumn("_hop", F.lit(hop).cast("bigint"))
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"phase_{p}").alias("_values")) for p in PHASES])
    long = sized.select("signal_id", *SIGNAL_COLUMNS, "_size", "_hop", "first_idx", F.inline(phases)).where(F.size("_values") > 0)
    first = F.expr("greatest(0L, (first_idx - _size + _hop) div _hop)")
    last = F.expr("(first_idx + size(_values) - 1) div _hop")
    covered = long.withColumn("window_no", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("window_no") * F.col("_hop") - F.col("first_idx"), F.lit(0).cast("bigint"))
    end = F.least(F.col("window_no") * F.col("_hop") + F.col("_size") - F.col("first_idx"), F.size("_values").cast("bigint"))
    cut = covered.withColumns({"_start": start, "_end": end}).where(F.col("_end") > F.col("_start"))
    return cut.select(
        *SEGMENT, *SIGNAL_COLUMNS, "_size", "_hop", (F.col("first_idx") + F.col("_start")).alias("at"),
        F.slice("_values", (F.col("_start") + 1).cast("int"), (F.col("_end") - F.col("_start")).cast("int")).alias("part"))


CLEANED = ("raw_count long, missing_count long, n_samples int, rms double, crest double, kurt double, skew double, mean double, "
           "std double, min double, max double")
SHAPED = "centroid double, bandwidth double, rolloff double, energy double"
# segments that a task describes together
TOGETHER = 2_048


def clean_segment(
    index: np.ndarray, values: np.ndarray, max_missing: float, min_length: int, kernel: int
) -> tuple[np.ndarray | None, int]:
    """Gate, trim, interpolate and filter one segment; None where it is dropped, and how many values are missing."""
    known = ~np.isnan(values)
    missing = int(len(values) - known.sum())
    if missing / len(values) > max_missing or not known.any():
        return None, missing
    if missing:
        low, high = index[known][0], index[known][-1]
        if high - low + 1 < min_length:
            return None, missing
        inside = (index >= low) & (index <= high)
        values = np.interp(index[inside], index[known], values[known])
        if len(values) >= kernel:
            padded = np.pad(values, kernel // 2)
            values = np.median(np.lib.stride_tricks.sliding_window_view(padded, kernel), axis=1)
    return values, missing


def _statistics(v: np.ndarray) -> list[float | None]:
    mean, rms = v.mean(), float(np.sqrt((v * v).mean()))
    apart = v - mean
    second = (apart**2).mean()
    peak = max(abs(v.min()), abs(v.max()))
    kurt = (apart**4).mean() / second**2 - 3 if second > 0 else None
    skew = (apart**3).mean() / second**1.5 if second > 0 else None
    return [rms, peak / rms if rms > 0 else 0.0, kurt, skew, mean, np.sqrt(second), v.min(), v.max()]


def _describe_kernel(names: list[str], max_missing: float, min_length: int, kernel: int, spectrum_size: int, peaks_type: pa.DataType) -> Callable:
    """Batches with ``ats`` and ``parts`` of a segment in order to the statistics and spectra of cleaned segments.

    One Python worker does it all; neither segments nor spectra leave it.
    """
    shape_names = [c.split()[0] for c in SHAPED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            kept, found, segments = [], [], []
            lists = batch.column(batch.schema.get_field_index("parts"))
            for row, (ats, parts) in enumerate(zip(batch.column(batch.schema.get_field_index("ats")).to_pylist(), lists)):
                arrays = [part.values.to_numpy(zero_copy_only=False).astype(float) for part in parts]
                index = np.concatenate([np.arange(at, at + len(a)) for at, a in zip(ats, arrays)])
                values, missing = clean_segment(index, np.concatenate(arrays), max_missing, min_length, kernel)
                if values is not None:
                    kept.append(row)
                    segments.append(values)
                    found.append((len(index), missing, len(values), *_statistics(values)))
            columns = list(zip(*found)) or [()] * 11
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 8]
            carried = [batch.column(batch.schema.get_field_index(n)).take(pa.array(kept, pa.int64())) for n in names]
            rates = carried[names.index("sample_rate_hz")].to_pandas()
            spectra = K.spectra_of(segments, spectrum_size)
            shapes = K.shapes_of(spectra, rates.to_numpy(dtype=float) / np.minimum(spectrum_size, np.array(columns[2], dtype=float)))
            peaks = K.peaks_of(spectra, columns[2], rates, spectrum_size)
            yield pa.RecordBatch.from_arrays(
                [*carried, *(pa.array(c, k) for c, k in zip(columns, kinds)),
                 *(pa.array(shapes[:, i], pa.float64(), from_pandas=True) for i in range(4)), pa.array(peaks, peaks_type)],
                names=[*names, *(c.split()[0] for c in CLEANED.split(", ")), *shape_names, "peaks"])

    return run


def features_from_chunks(
    chunks: DataFrame, size: int | None = None, hop: int | None = None, window_ms: int = W.WINDOW_MS,
    overlap: float = W.OVERLAP, min_length: int = W.MIN_CLEAN_LENGTH, kernel: int = W.MEDIAN_KERNEL,
    max_missing: float = W.MAX_MISSING, spectrum_size: int = W.SPECTRUM_SIZE,
) -> DataFrame:
    """The features of ``extract_features`` straight from stored chunks.

    Windows are cut out of the chunks' arrays as slices and stitched by window; no sample
    is ever a row of its own, and one exchange carries a few arrays per window.  Chunks
    are ``(signal_id, samples_count, recorded_at, sample_rate_hz, first_idx, phase_a/b/c)``;
    a phase that a chunk lacks leaves a hole there, as it does in the long samples.
    """
    carried = [*SIGNAL_COLUMNS, "_size", "_hop", "_reach"]
    slices = window_slices(chunks, size, hop, window_ms, overlap)
    windows = slices.groupBy(*WINDOW, *SIGNAL_COLUMNS, "_size", "_hop").agg(
        F.collect_list(F.struct("phase", "at", "part")).alias("_slices"), F.max(F.col("at") + F.size("part") - 1).alias("_reach"))
    whole = windows.where(_is_complete(F.col("_reach")))

    def of(phase: str) -> Column:
        own = F.array_sort(F.filter("_slices", lambda s: s["phase"] == phase))
        return F.struct(F.lit(phase).alias("phase"), F.transform(own, lambda s: s["at"]).alias("ats"),
                        F.transform(own, lambda s: s["part"]).alias("parts"))

    phased = whole.select(*WINDOW, *carried, F.inline(F.array(*[of(p) for p in PHASES]))).where(F.size("ats") > 0)
    names = [*SEGMENT, *carried]
    described = T.StructType.fromDDL(f"{CLEANED}, {SHAPED}, peaks {K.PEAKS_TYPE}").fields
    schema = T.StructType([*(phased.schema[n] for n in names), *described])
    segments = phased.mapInArrow(
        _describe_kernel(names, max_missing, min_length, kernel, spectrum_size, to_arrow_type(schema["peaks"].dataType)), schema)
    return _wide_rows(P.dominant_frequency(segments), carried, window_ms)


def extraction_summary(signals: DataFrame, features: DataFrame) -> DataFrame:
    """Per signal: number of feature rows and whether it produced any."""
    created = features.groupBy(F.col("signal_id").alias("id")).agg(F.count(F.lit(1)).alias("created"))
    return signals.select("id").join(created, "id", "left").select(
        "id",
        F.coalesce("created", F.lit(0)).cast("bigint").alias("created_features"),
        F.when(F.col("created") > 0, "processed").otherwise("error").alias("outcome"),
    )


def extraction_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("outcome") == "processed").alias("processed_signals"),
        F.coalesce(F.sum("created_features"), F.lit(0)).cast("bigint").alias("created_features"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
