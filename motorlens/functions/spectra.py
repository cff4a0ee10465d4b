"""Arrow kernels for window spectra.

Each call sees a batch of windows that Spark has already grouped; a window is
at most one analysis window long, so no row grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value

by_value(__name__)

# fixed values of the peak search
PEAK_HEIGHT = 0.1
PEAK_PROMINENCE = 0.5
PEAK_SPACING_HZ = 50
TOP_PEAKS = 10
ROLLOFF = 0.85

SHAPE_TYPE = "struct<centroid:double,bandwidth:double,rolloff:double,energy:double>"
PEAKS_TYPE = "array<struct<frequency:double,amplitude:double,prominence:double>>"


def mean_magnitudes(block: np.ndarray, size: int) -> np.ndarray:
    """Mean Hann-windowed magnitude spectrum for rows of equal length; shape (rows, size // 2)."""
    hop = size // 2
    segments = np.lib.stride_tricks.sliding_window_view(block, size, axis=1)[:, ::hop, :]
    return np.abs(np.fft.rfft(segments * np.hanning(size), axis=2))[:, :, : size // 2].mean(axis=1)


def spectra_of(segments: Sequence, size: int) -> np.ndarray:
    """Magnitudes of every segment, None where it has fewer than two values."""
    lengths = np.array([0 if v is None else len(v) for v in segments], dtype=int)
    out = np.empty(len(segments), dtype=object)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        if length < 2:
            continue
        block = np.stack([np.asarray(segments[r], dtype=float) for r in rows])
        for r, spectrum in zip(rows, mean_magnitudes(block, min(size, int(length)))):
            out[r] = spectrum
    return out


def averaged_spectrum(values: Column, size: int) -> Column:
    """``ARRAY<DOUBLE>`` of magnitudes; the size shrinks to the window when that is shorter."""

    @F.pandas_udf("array<double>")
    def kernel(batch: pd.Series) -> pd.Series:
        return pd.Series(spectra_of(batch.to_numpy(), size))

    return kernel(values)


def peak_positions(magnitudes: np.ndarray, height: float, spacing: int, prominence: float) -> list[tuple[int, float]]:
    """``(bin, prominence)`` of local maxima: height first, then spacing (highest wins), then prominence."""
    change = np.flatnonzero(np.diff(magnitudes)) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(magnitudes)]])
    levels = magnitudes[starts]
    # a run of equal values is one maximum, reported at its middle; the outer runs are never maxima
    top = np.flatnonzero((levels[1:-1] > levels[:-2]) & (levels[1:-1] > levels[2:])) + 1 if len(levels) > 2 else []
    bins = np.array([(starts[t] + ends[t] - 1) // 2 for t in top], dtype=int)
    bins = bins[magnitudes[bins] >= height]
    kept = np.ones(len(bins), dtype=bool)
    for j in np.argsort(magnitudes[bins], kind="stable")[::-1]:
        if kept[j]:
            close = np.abs(bins - bins[j]) < spacing
            close[j] = False
            kept &= ~close
    found = []
    for b in bins[kept]:
        higher_left = np.flatnonzero(magnitudes[:b] > magnitudes[b])
        higher_right = np.flatnonzero(magnitudes[b + 1 :] > magnitudes[b])
        left = higher_left[-1] if len(higher_left) else 0
        right = b + 1 + higher_right[0] if len(higher_right) else len(magnitudes) - 1
        base = max(magnitudes[left : b + 1].min(), magnitudes[b : right + 1].min())
        if magnitudes[b] - base >= prominence:
            found.append((int(b), float(magnitudes[b] - base)))
    return found


def peaks_of(spectra: Iterable, lengths: Iterable, rates: Iterable, size: int, top: int = TOP_PEAKS) -> list[list[dict] | None]:
    """Strongest peaks of every spectrum, strongest first; None where the spacing of 50 Hz is below one bin."""
    out = []
    for magnitudes, n, hz in zip(spectra, lengths, rates):
        if magnitudes is None or len(magnitudes) == 0:
            out.append(None)
            continue
        magnitudes = np.asarray(magnitudes, dtype=float)
        spacing = int(PEAK_SPACING_HZ * len(magnitudes) / (hz / 2))
        if spacing < 1:
            out.append(None)
            continue
        height = PEAK_HEIGHT * magnitudes.max()
        peaks = peak_positions(magnitudes, height, spacing, height * PEAK_PROMINENCE)
        peaks.sort(key=lambda peak: -magnitudes[peak[0]])
        step = hz / min(size, n)
        out.append(
            [
                {"frequency": b * step, "amplitude": float(magnitudes[b]), "prominence": p}
                for b, p in peaks[:top]
            ]
        )
    return out


def spectral_peaks(spectrum: Column, length: Column, rate: Column, size: int, top: int = TOP_PEAKS) -> Column:
    """Strongest peaks, strongest first; NULL where the spacing of 50 Hz is below one bin."""

    @F.pandas_udf(PEAKS_TYPE)
    def kernel(spectra: pd.Series, lengths: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series(peaks_of(spectra, lengths, rates, size, top))

    return kernel(spectrum, length, rate)


def shapes_of(spectra: Sequence, steps: np.ndarray) -> np.ndarray:
    """Centroid, bandwidth, 85% roll-off and total magnitude of every spectrum, NaN where there is none."""
    out = np.full((len(spectra), 4), np.nan)
    lengths = np.array([0 if m is None else len(m) for m in spectra], dtype=int)
    for n in np.unique(lengths[lengths > 0]):
        # spectra of one length share the array operations
        rows = np.flatnonzero(lengths == n)
        magnitudes = np.stack([np.asarray(spectra[r], dtype=float) for r in rows])
        frequencies = np.arange(n) * steps[rows][:, None]
        total = magnitudes.sum(axis=1)
        share = magnitudes / np.where(total == 0, 1.0, total)[:, None]
        centroid = (frequencies * share).sum(axis=1)
        reached = np.cumsum(share, axis=1) >= ROLLOFF
        at = np.where(reached.any(axis=1), reached.argmax(axis=1), n - 1)
        bandwidth = np.sqrt(((frequencies - centroid[:, None]) ** 2 * share).sum(axis=1))
        shape = np.column_stack([centroid, bandwidth, frequencies[np.arange(len(rows)), at], total])
        out[rows] = np.where(total[:, None] == 0, 0.0, shape)
    return out


def spectral_shape(spectrum: Column, step: Column) -> Column:
    """Struct of centroid, bandwidth, 85% roll-off and total magnitude; all zero for a silent spectrum."""

    @F.pandas_udf(SHAPE_TYPE)
    def kernel(spectra: pd.Series, steps: pd.Series) -> pd.DataFrame:
        shape = pd.DataFrame(
            shapes_of(spectra.to_numpy(), steps.to_numpy(dtype=float)), columns=["centroid", "bandwidth", "rolloff", "energy"])
        return shape.astype(object).where(shape.notna(), None)

    return kernel(spectrum, step)
