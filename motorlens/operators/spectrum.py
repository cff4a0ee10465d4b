"""Spectra and frequency features per window and phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlens.functions import spectra as K
from motorlens.functions.expressions import PHASES
from motorlens.operators.windows import SEGMENT, SPECTRUM_SIZE, WINDOW


def segment_arrays(cleaned: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Ordered values of each (window, phase) as one array; at most one window long."""
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    kept = [F.first(name).alias(name) for name in keep or []]
    return cleaned.groupBy(*SEGMENT).agg(F.transform(ordered, lambda s: s["value"]).alias("segment"), *kept)


def averaged_spectrum(segments: DataFrame, size: int = SPECTRUM_SIZE) -> DataFrame:
    """Adds ``spectrum`` and the number of samples it was taken from."""
    return segments.withColumn("n_samples", F.size("segment")).withColumn(
        "spectrum", K.averaged_spectrum(F.col("segment"), size)
    )


def spectral_shape(spectra: DataFrame, rate: str = "sample_rate_hz", size: int = SPECTRUM_SIZE) -> DataFrame:
    step = F.col(rate) / F.least(F.lit(size), F.col("n_samples"))
    shaped = spectra.withColumn("_shape", K.spectral_shape(F.col("spectrum"), step))
    for name in ("centroid", "bandwidth", "rolloff", "energy"):
        shaped = shaped.withColumn(name, F.col("_shape")[name])
    return shaped.drop("_shape")


def spectral_peaks(
    spectra: DataFrame, rate: str = "sample_rate_hz", size: int = SPECTRUM_SIZE, top: int = K.TOP_PEAKS
) -> DataFrame:
    return spectra.withColumn(
        "peaks", K.spectral_peaks(F.col("spectrum"), F.col("n_samples"), F.col(rate), size, top)
    )


def dominant_frequency(peaked: DataFrame) -> DataFrame:
    """Frequency of the strongest peak, 0 when there is none, NULL when the frequency part failed."""
    strongest = F.coalesce(F.try_element_at("peaks", F.lit(1))["frequency"], F.lit(0.0))
    return peaked.withColumn("dominant_frequency", F.when(F.col("peaks").isNotNull(), strongest))


def pack_spectrum(described: DataFrame, rate: str = "sample_rate_hz") -> DataFrame:
    """One struct per phase with the compact spectrum; NULL where the frequency part is undefined."""
    packed = F.when(
        F.col("peaks").isNotNull(),
        F.struct(
            "peaks",
            F.col("centroid").alias("spectral_centroid"),
            F.col("bandwidth").alias("spectral_bandwidth"),
            F.col("rolloff").alias("spectral_rolloff"),
            F.col("energy").alias("spectral_energy"),
            "dominant_frequency",
            F.col(rate).alias("sample_rate"),
        ),
    )
    columns = [F.max(F.when(F.col("phase") == p, packed)).alias(f"phase_{p}") for p in PHASES]
    return described.groupBy(*WINDOW).agg(*columns)


def spectrum_rows(spectra: DataFrame, rate: str = "sample_rate_hz", size: int = SPECTRUM_SIZE) -> DataFrame:
    """Spectrum arrays as ``(frequency, magnitude)`` rows."""
    step = F.col(rate) / F.least(F.lit(size), F.col("n_samples"))
    return spectra.select(*SEGMENT, step.alias("_step"), F.posexplode("spectrum").alias("bin", "magnitude")).select(
        *SEGMENT, "bin", (F.col("bin") * F.col("_step")).alias("frequency"), "magnitude"
    )


def describe_spectrum(segments: DataFrame, rate: str = "sample_rate_hz", size: int = SPECTRUM_SIZE) -> DataFrame:
    """Spectrum, shape, peaks and dominant frequency in one chain."""
    return dominant_frequency(spectral_peaks(spectral_shape(averaged_spectrum(segments, size), rate, size), rate, size))
