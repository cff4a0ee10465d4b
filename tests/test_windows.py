"""Closed-form cases for cutting, cleaning, statistics and spectra."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlens.functions import spectra as K
from motorlens.operators import features as X
from motorlens.operators import spectrum as P
from motorlens.operators import windows as W

SCHEMA = "signal_id long, phase string, sample_idx long, value double"


def frame(spark, values, phase="a", signal=1):
    rows = [(signal, phase, i, None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def one_window(df):
    return df.withColumn("window_no", F.lit(0).cast("long"))


def cleaned(spark, values, **options):
    rows = W.clean_windows(one_window(frame(spark, values)), **options).orderBy("sample_idx").collect()
    return np.array([r["value"] for r in rows])


@pytest.mark.parametrize("length,size,hop", [(100, 32, 16), (32, 32, 16), (33, 32, 16), (20, 32, 16), (100, 10, 10), (47, 32, 8)])
def test_window_count(spark, length, size, hop):
    windows = W.sliding_windows(frame(spark, np.arange(length)), size, hop)
    expected = max(1, (length - size) // hop + 1)
    counts = {r["window_no"]: r["count"] for r in windows.groupBy("window_no").count().collect()}
    assert sorted(counts) == list(range(expected))
    assert set(counts.values()) == {min(length, size)}


def test_window_count_follows_the_longest_phase(spark):
    both = frame(spark, np.arange(64)).union(frame(spark, np.arange(40), "b"))
    windows = W.sliding_windows(both, 32, 16).groupBy("window_no", "phase").count().collect()
    found = {(r["window_no"], r["phase"]): r["count"] for r in windows}
    assert found == {(0, "a"): 32, (1, "a"): 32, (2, "a"): 32, (0, "b"): 32, (1, "b"): 24, (2, "b"): 8}


def test_ramp_gap_is_filled_on_the_line(spark):
    ramp = np.linspace(0, 10, 150)
    holed = ramp.copy()
    holed[70] = np.nan
    rows = W.interpolate_gaps(W.trim_missing(W.missing_gate(one_window(frame(spark, holed)))))
    value = rows.where("sample_idx = 70").first()["value"]
    assert abs(value - ramp[70]) < 1e-12


def test_outer_gaps_are_trimmed(spark):
    padded = np.concatenate([[np.nan] * 5, np.linspace(0, 10, 150), [np.nan] * 3])
    assert len(cleaned(spark, padded)) == 150


def test_too_many_gaps_are_refused(spark):
    values = np.linspace(0, 1, 150)
    values[::3] = np.nan
    assert len(cleaned(spark, values)) == 0


def test_short_segment_is_only_refused_when_it_has_gaps(spark):
    values = np.linspace(0, 1, 50)
    assert len(cleaned(spark, values)) == 50
    values[20] = np.nan
    assert len(cleaned(spark, values)) == 0


def test_median_filter_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=200)
    values[[30, 31, 90]] = np.nan
    index = np.arange(200)
    known = ~np.isnan(values)
    filled = np.interp(index, index[known], values[known])
    padded = np.concatenate([np.zeros(25), filled, np.zeros(25)])
    expected = np.median(np.lib.stride_tricks.sliding_window_view(padded, 51), axis=1)
    assert np.allclose(cleaned(spark, values), expected)


def test_statistics_on_hand_values(spark):
    df = one_window(frame(spark, [1, 2, 3, 4, 5]))
    row = W.stat_features(df).first()
    v = np.array([1, 2, 3, 4, 5.0])
    assert row["mean"] == 3 and row["min"] == 1 and row["max"] == 5
    assert abs(row["rms"] - np.sqrt((v**2).mean())) < 1e-12
    assert abs(row["crest"] - 5 / np.sqrt((v**2).mean())) < 1e-12
    assert abs(row["std"] - v.std()) < 1e-12
    assert abs(row["skew"]) < 1e-12
    assert abs(row["kurt"] - (((v - 3) ** 4).mean() / v.var() ** 2 - 3)) < 1e-12


def test_zero_signal_has_zero_crest(spark):
    row = W.stat_features(one_window(frame(spark, np.zeros(20)))).first()
    assert row["rms"] == 0 and row["crest"] == 0


def described(spark, signal, rate=1000, size=W.SPECTRUM_SIZE):
    segments = P.segment_arrays(one_window(frame(spark, signal))).withColumn("sample_rate_hz", F.lit(rate))
    return P.describe_spectrum(segments, size=size).first()


def test_sine_is_found(spark):
    t = np.arange(1000) / 1000
    row = described(spark, np.sin(2 * np.pi * 50 * t))
    assert abs(row["dominant_frequency"] - 50) < 5
    assert row["centroid"] > 0 and row["bandwidth"] > 0 and row["rolloff"] > 0 and row["energy"] > 0


def test_two_components_are_found(spark):
    t = np.arange(1000) / 1000
    row = described(spark, np.sin(2 * np.pi * 50 * t) + 0.5 * np.sin(2 * np.pi * 150 * t))
    found = [p["frequency"] for p in row["peaks"]]
    assert any(abs(f - 50) < 5 for f in found) and any(abs(f - 150) < 5 for f in found)


def test_at_most_ten_peaks(spark):
    t = np.arange(4000) / 4000
    tones = sum(np.sin(2 * np.pi * f * t) for f in range(100, 1700, 100))
    assert len(described(spark, tones, rate=4000)["peaks"]) == 10


def test_spectrum_equals_direct_computation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    segments = P.segment_arrays(one_window(frame(spark, x))).withColumn("sample_rate_hz", F.lit(1000))
    found = np.array(P.averaged_spectrum(segments, 128).first()["spectrum"])
    parts = [x[s : s + 128] * np.hanning(128) for s in range(0, 300 - 128 + 1, 64)]
    expected = np.mean([np.abs(np.fft.fft(p))[:64] for p in parts], axis=0)
    assert np.allclose(found, expected)


def test_peak_rules():
    m = np.array([0, 5, 1, 4, 1, 1, 3, 3, 3, 0, 0.2, 0.1])
    bins = lambda **k: [b for b, _ in K.peak_positions(m, **k)]
    assert bins(height=0.5, spacing=1, prominence=0.1) == [1, 3, 7]  # a plateau reports its middle
    assert bins(height=0.5, spacing=3, prominence=0.1) == [1, 7]  # the higher neighbour wins
    assert bins(height=0.5, spacing=1, prominence=3.5) == [1]
    assert dict(K.peak_positions(m, 0.5, 1, 0.1))[3] == 3.0


def test_short_window_has_no_frequency_part(spark):
    row = described(spark, np.sin(np.arange(20)), rate=25600)
    assert row["peaks"] is None and row["dominant_frequency"] is None


def test_realistic_three_phase_recording(spark):
    rate, n = 25600, 2560
    t = np.arange(n) / rate
    rng = np.random.default_rng(5)
    frames = [
        frame(spark, 10 * np.sin(2 * np.pi * 50 * t + k * 2 * np.pi / 3) + 0.5 * np.sin(2 * np.pi * 150 * t) + rng.normal(0, 0.1, n), p)
        for k, p in enumerate("abc")
    ]
    samples = frames[0].union(frames[1]).union(frames[2]).select(
        "*", F.lit(rate).alias("sample_rate_hz"), F.lit(n).alias("samples_count"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("recorded_at"),
    )
    rows = X.extract_features(samples).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["processed_phases"] == 3
    for p in "abc":
        assert 6 <= row[f"rms_{p}"] <= 15
        assert 40 <= row[f"phase_{p}"]["dominant_frequency"] <= 60
    assert (row["window_end"] - row["window_start"]).total_seconds() == 1.0  # shorter than a window


def test_own_window_size_per_signal(spark):
    rows = spark.createDataFrame([(1000, 500), (1000, 5000), (25600, 100_000)], "rate int, n int").withColumn(
        "size", W.window_size("rate", "n")
    )
    assert [r["size"] for r in rows.collect()] == [1000, 4096, 25600]


def test_preview_and_slice(spark):
    df = frame(spark, np.arange(1000))
    rows = W.preview(df, 100).orderBy("sample_idx").collect()
    assert [r["value"] for r in rows] == list(np.arange(1000)[::10][:100])
    cut = [r["value"] for r in W.slice_samples(df, 5, 30, 7).orderBy("sample_idx").collect()]
    assert cut == list(np.arange(1000)[5:30][::7])


def test_time_axis_includes_both_ends(spark):
    rows = W.time_axis(frame(spark, np.arange(11)), 10).orderBy("sample_idx").collect()
    assert np.allclose([r["seconds"] for r in rows], np.linspace(0, 1.1, 11))


def test_chunks_round_trip(spark):
    from motorlens.operators import ingest as I

    rows = spark.createDataFrame([("f", i, float(i), None, float(-i) if i % 3 else None) for i in range(25)],
                                 "file string, row_no long, a double, b double, c double")
    chunks = I.chunk_signals(rows, 10)
    assert chunks.where("phase_b is not null").count() == 0
    signals = chunks.select(
        F.col("file").alias("signal_id"), F.lit(25).alias("samples_count"), F.lit(100).alias("sample_rate_hz"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("recorded_at"), "first_idx", "phase_a", "phase_b", "phase_c",
    )
    back = X.samples_from_chunks(signals).where("phase = 'a'").orderBy("sample_idx").collect()
    assert [r["value"] for r in back] == [float(i) for i in range(25)]


def _chunk_rows(rng, n, chunk, holes):
    """Chunks of one recording with gaps; a phase may lack whole chunks."""
    out = []
    for first in range(0, n, chunk):
        values = {}
        for p in "abc":
            v = [None if rng.random() < holes else float(np.float32(rng.gauss(0, 3))) for _ in range(min(chunk, n - first))]
            values[p] = None if (p == "b" and first // chunk % 4 == 2) or all(x is None for x in v) else v
        if any(values.values()):
            out.append((first, values))
    return out


@pytest.mark.parametrize("size, hop, chunk, holes", [(32, 16, 10, 0.05), (32, 16, 100, 0.3), (20, 7, 16, 0.1), (64, 64, 500, 0.0), (None, None, 900, 0.02)])
def test_features_from_chunks_equal_those_from_samples(spark, size, hop, chunk, holes):
    import random

    rng, rows = random.Random(4), []
    for signal, n in ((1, 150), (2, 31), (3, 257), (4, 3)):
        for first, v in _chunk_rows(rng, n, chunk, holes):
            rows.append((signal, n, datetime(2024, 1, 1), 200, first, v["a"], v["b"], v["c"]))
    chunks = spark.createDataFrame(rows, "signal_id bigint, samples_count bigint, recorded_at timestamp_ntz, sample_rate_hz int, "
                                         "first_idx bigint, phase_a array<float>, phase_b array<float>, phase_c array<float>")
    options = {"size": size, "hop": hop, "min_length": 6, "kernel": 5, "spectrum_size": 16}
    by_slice = X.features_from_chunks(chunks, **options)
    by_sample = X.extract_features(X.samples_from_chunks(chunks), **options)
    assert by_slice.columns == by_sample.columns
    left, right = ({(r["signal_id"], r["window_no"]): r for r in df.collect()} for df in (by_slice, by_sample))
    assert left.keys() == right.keys() and left

    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a))
        if hasattr(a, "asDict"):
            return all(same(x, y) for x, y in zip(a, b))
        return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a == b

    for key, row in left.items():
        for name in row.asDict():
            assert same(row[name], right[key][name]), (key, name, row[name], right[key][name])


def test_features_from_chunks_use_one_python_worker_a_task(spark):
    """Cleaning, statistics, spectra and peaks of a segment share a worker, so an executor has one per core."""
    rows = [(1, 64, datetime(2024, 1, 1), 200, 0, *[[float(np.sin(i * k)) for i in range(64)] for k in (1, 2)], None)]
    chunks = spark.createDataFrame(rows, "signal_id bigint, samples_count bigint, recorded_at timestamp_ntz, sample_rate_hz int, "
                                         "first_idx bigint, phase_a array<float>, phase_b array<float>, phase_c array<float>")
    features = X.features_from_chunks(chunks, size=32, hop=16, spectrum_size=16)
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(node) for node in ("MapInArrow", "ArrowEvalPython", "MapInPandas")) == 1
    assert features.where("phase_a.spectral_energy > 0 and phase_c is null").count() == 3
