"""Registered queries: spectra of the cleaned windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlens.functions.expressions import PHASES
from motorlens.operators import features as X
from motorlens.operators import ingest as I
from motorlens.operators import spectrum as P
from motorlens.operators import windows as W
from motorlens.plans.registry import query
from motorlens.plans.signal_queries import CLEAN, HOP, KERNEL, MIN_LENGTH, RATE, SIZE, stats_sql
from motorlens.plans.sql_frames import r6, with_frames
from motorlens.session import materialise
from motorlens.sources import star_tables as S

FFT = 16
# 16 bins at this rate put neighbouring bins just inside the 50 Hz spacing rule
PEAK_FFT = 32


def spectra_sql(fft):
    return CLEAN + f"""
placed AS (
    SELECT signal_id, window_no, phase, value, i, n, least({fft}, n) AS size
    FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, window_no, phase ORDER BY sample_idx) - 1 AS i,
                 count(*) OVER (PARTITION BY signal_id, window_no, phase) AS n FROM smoothed)),
segments AS (
    SELECT p.*, seg.s, p.i - seg.s * (p.size // 2) AS j
    FROM placed p, LATERAL (SELECT unnest(range(0, (p.n - p.size) // (p.size // 2) + 1)) AS s) seg
    WHERE p.i - seg.s * (p.size // 2) BETWEEN 0 AND p.size - 1),
tapered AS (SELECT *, value * (0.5 - 0.5 * cos(2 * pi() * j / (size - 1))) AS x FROM segments),
magnitudes AS (
    SELECT signal_id, window_no, phase, n, size, s, k,
           sqrt(sum(x * cos(2 * pi() * k * j / size)) ** 2 + sum(x * sin(2 * pi() * k * j / size)) ** 2) AS m
    FROM tapered t, LATERAL (SELECT unnest(range(0, t.size // 2)) AS k) b
    GROUP BY signal_id, window_no, phase, n, size, s, k),
spectra AS (
    SELECT signal_id, window_no, phase, n, k AS bin, k * {RATE}.0::DOUBLE / size AS frequency, avg(m) AS magnitude
    FROM magnitudes GROUP BY signal_id, window_no, phase, n, k, size),"""


SPECTRA = spectra_sql(FFT)

# With one bin of spacing no maximum hides another, so height and prominence decide.
PEAKS = spectra_sql(PEAK_FFT) + """
candidates AS (
    SELECT *, first_value(magnitude) OVER (PARTITION BY signal_id, window_no, phase ORDER BY magnitude DESC) AS highest
    FROM (SELECT *, lag(magnitude) OVER seg AS before, lead(magnitude) OVER seg AS after
          FROM spectra WINDOW seg AS (PARTITION BY signal_id, window_no, phase ORDER BY bin))),
edges AS (
    SELECT c.signal_id, c.window_no, c.phase, c.n, c.bin, c.frequency, c.magnitude, c.highest,
           max(o.bin) FILTER (o.bin < c.bin AND o.magnitude > c.magnitude) AS l,
           min(o.bin) FILTER (o.bin > c.bin AND o.magnitude > c.magnitude) AS r
    FROM candidates c JOIN spectra o USING (signal_id, window_no, phase)
    WHERE c.magnitude > c.before AND c.magnitude > c.after AND c.magnitude >= 0.1 * c.highest AND c.n >= 20
    GROUP BY ALL),
prominent AS (
    SELECT e.signal_id, e.window_no, e.phase, e.frequency, e.magnitude, e.highest,
           e.magnitude - greatest(min(o.magnitude) FILTER (o.bin BETWEEN coalesce(e.l, 0) AND e.bin),
                                  min(o.magnitude) FILTER (o.bin BETWEEN e.bin AND coalesce(e.r, 1000000))) AS prominence
    FROM edges e JOIN spectra o USING (signal_id, window_no, phase) 
    GROUP BY e.signal_id, e.window_no, e.phase, e.bin, e.frequency, e.magnitude, e.highest),
peaks AS (
    SELECT *, row_number() OVER (PARTITION BY signal_id, window_no, phase ORDER BY magnitude DESC) - 1 AS rank
    FROM prominent WHERE prominence >= 0.05 * highest),"""


def _segments(spark, sf_dir):
    windows = W.sliding_windows(S.samples(spark, sf_dir), SIZE, HOP)
    cleaned = W.clean_windows(windows, min_length=MIN_LENGTH, kernel=KERNEL)
    return P.segment_arrays(cleaned).withColumn("sample_rate_hz", F.lit(RATE))


def _described(spark, sf_dir):
    return P.describe_spectrum(_segments(spark, sf_dir), size=PEAK_FFT)


@query(
    "averaged_spectrum",
    with_frames(
        "samples",
        f"SELECT signal_id, window_no, phase, bin, {r6('frequency')} AS frequency, {r6('magnitude')} AS magnitude FROM spectra",
        SPECTRA,
    ),
)
def averaged_spectrum(spark, sf_dir):
    """Also the long form of a spectrum (frequency, magnitude rows)."""
    rows = P.spectrum_rows(P.averaged_spectrum(_segments(spark, sf_dir), FFT), size=FFT)
    return rows.withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "spectral_shape",
    with_frames(
        "samples",
        f"""SELECT signal_id, window_no, phase,
               {r6('any_value(centroid)')} AS centroid,
               {r6('sqrt(sum((frequency - centroid) ** 2 * magnitude / total))')} AS bandwidth,
               {r6('coalesce(min(frequency) FILTER (upto / total >= 0.85), max(frequency))')} AS rolloff,
               {r6('any_value(total)')} AS energy
        FROM (SELECT *, sum(frequency * magnitude / total) OVER (PARTITION BY signal_id, window_no, phase) AS centroid
              FROM (SELECT *, sum(magnitude) OVER (PARTITION BY signal_id, window_no, phase) AS total,
                           sum(magnitude) OVER (PARTITION BY signal_id, window_no, phase ORDER BY bin) AS upto
                    FROM spectra))
        GROUP BY signal_id, window_no, phase""",
        SPECTRA,
    ),
)
def spectral_shape(spark, sf_dir):
    shaped = P.spectral_shape(P.averaged_spectrum(_segments(spark, sf_dir), FFT), size=FFT)
    return shaped.select(*W.SEGMENT, "centroid", "bandwidth", "rolloff", "energy")


@query(
    "spectral_peaks",
    with_frames(
        "samples",
        f"""SELECT signal_id, window_no, phase, rank, {r6('frequency')} AS frequency, {r6('magnitude')} AS amplitude,
                   {r6('prominence')} AS prominence FROM peaks WHERE rank < 10""",
        PEAKS,
    ),
)
def spectral_peaks(spark, sf_dir):
    described = _described(spark, sf_dir)
    return described.select(*W.SEGMENT, F.posexplode("peaks").alias("rank", "peak")).select(
        *W.SEGMENT, F.col("rank").cast("bigint").alias("rank"), "peak.frequency", "peak.amplitude", "peak.prominence"
    )


@query(
    "dominant_frequency",
    with_frames(
        "samples",
        f"""SELECT s.signal_id, s.window_no, s.phase,
                   {r6('CASE WHEN n >= 20 THEN coalesce(p.frequency, 0) END')} AS dominant_frequency
            FROM (SELECT DISTINCT signal_id, window_no, phase, n FROM spectra) s
            LEFT JOIN peaks p ON p.signal_id = s.signal_id AND p.window_no = s.window_no AND p.phase = s.phase
                AND p.rank = 0""",
        PEAKS,
    ),
)
def dominant_frequency(spark, sf_dir):
    return _described(spark, sf_dir).select(*W.SEGMENT, "dominant_frequency")


@query(
    "pack_spectrum",
    with_frames(
        "samples",
        f"""SELECT s.signal_id, s.window_no, s.phase, {r6('s.centroid')} AS spectral_centroid, {r6('s.bandwidth')} AS spectral_bandwidth,
                   {r6('s.rolloff')} AS spectral_rolloff, {r6('s.energy')} AS spectral_energy,
                   {r6('coalesce(p.frequency, 0)')} AS dominant_frequency, coalesce(p.n_peaks, 0) AS n_peaks,
                   {r6('coalesce(p.total, 0)')} AS peak_total, {RATE}::BIGINT AS sample_rate
            FROM (SELECT signal_id, window_no, phase, any_value(n) AS n, any_value(centroid) AS centroid,
                         sqrt(sum((frequency - centroid) ** 2 * magnitude / total)) AS bandwidth,
                         coalesce(min(frequency) FILTER (upto / total >= 0.85), max(frequency)) AS rolloff, any_value(total) AS energy
                  FROM (SELECT *, sum(frequency * magnitude / total) OVER (PARTITION BY signal_id, window_no, phase) AS centroid
                        FROM (SELECT *, sum(magnitude) OVER (PARTITION BY signal_id, window_no, phase) AS total,
                                     sum(magnitude) OVER (PARTITION BY signal_id, window_no, phase ORDER BY bin) AS upto
                              FROM spectra)) GROUP BY 1, 2, 3) s
            LEFT JOIN (SELECT signal_id, window_no, phase, max(frequency) FILTER (rank = 0) AS frequency, count(*) AS n_peaks,
                              sum(magnitude) AS total FROM peaks WHERE rank < 10 GROUP BY 1, 2, 3) p USING (signal_id, window_no, phase)
            WHERE s.n >= 20""",
        PEAKS,
    ),
)
def pack_spectrum(spark, sf_dir):
    """The packed structs, unpacked to one row per phase."""
    packed = P.pack_spectrum(_described(spark, sf_dir))
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"phase_{p}").alias("packed")) for p in "abc"])
    rows = packed.select(*W.WINDOW, F.inline(phases)).where(F.col("packed").isNotNull())
    one = lambda name: F.col(f"packed.{name}")
    return rows.select(
        *W.SEGMENT, *[one(c) for c in ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_energy", "dominant_frequency")],
        F.size(one("peaks")).cast("bigint").alias("n_peaks"),
        F.aggregate(one("peaks"), F.lit(0.0), lambda total, peak: total + peak["amplitude"]).alias("peak_total"),
        one("sample_rate").cast("bigint").alias("sample_rate"),
    )


@query("extract_features", None)
def extract_features(spark, sf_dir):
    """Statistics and spectra of every window in one plan."""
    samples = S.samples(spark, sf_dir).select(
        "*", F.lit(RATE).alias("sample_rate_hz"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("recorded_at")
    )
    rows = X.extract_features(
        samples, size=SIZE, hop=HOP, min_length=MIN_LENGTH, kernel=KERNEL, spectrum_size=PEAK_FFT
    )
    spectra = [F.to_json(f"phase_{p}").alias(f"phase_{p}") for p in "abc"]
    return rows.select(*[c for c in rows.columns if not c.startswith("phase_")], *spectra)


@query(
    "extraction_summary",
    with_frames(
        "samples",
        """SELECT count(*) FILTER (n > 0) AS processed_signals, coalesce(sum(n), 0)::BIGINT AS created_features,
                  count(*) FILTER (n = 0) AS errors
           FROM (SELECT l.signal_id, count(w.window_no) AS n FROM lengths l
                 LEFT JOIN (SELECT DISTINCT signal_id, window_no FROM smoothed) w USING (signal_id) GROUP BY 1)""",
        CLEAN,
    ),
)
def extraction_summary(spark, sf_dir):
    samples = S.samples(spark, sf_dir)
    windows = W.clean_windows(W.sliding_windows(samples, SIZE, HOP), min_length=MIN_LENGTH, kernel=KERNEL)
    signals = samples.select(F.col("signal_id").alias("id")).distinct()
    return X.extraction_totals(X.extraction_summary(signals, W.assemble_features(W.stat_features(windows))))


CHUNK = 100
CHUNKED = f"""
pivoted AS (
    SELECT signal_id, sample_idx, phase, max(v.value) AS value
    FROM (SELECT DISTINCT signal_id, sample_idx FROM samples) i CROSS JOIN (VALUES ('a'), ('b'), ('c')) p(phase)
    LEFT JOIN samples v USING (signal_id, sample_idx, phase) GROUP BY ALL),
chunked AS (
    SELECT signal_id, signal_id AS equipment_id, phase, sample_idx, value::FLOAT::DOUBLE AS value FROM pivoted
    QUALIFY count(value) OVER (PARTITION BY signal_id, phase, sample_idx // {CHUNK}) > 0),"""


def _chunks(spark, sf_dir):
    """Chunks as the loader stores them, written and read again."""
    long = S.samples(spark, sf_dir)
    rows = long.groupBy(F.col("signal_id").alias("file"), F.col("sample_idx").alias("row_no")).agg(
        *[F.max(F.when(F.col("phase") == p, F.col("value"))).alias(p) for p in PHASES])
    chunks = I.chunk_signals(rows, CHUNK).withColumnRenamed("file", "signal_id")
    return materialise(chunks.withColumn("sample_rate_hz", F.lit(RATE)).withColumn(
        "recorded_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


@query(
    "features_from_chunks",
    with_frames(
        "samples",
        f"""SELECT s.signal_id, s.window_no, count(*) AS processed_phases, {', '.join(
            f"max({r6(f'"{stat}"')}) FILTER (phase = '{p}') AS {stat}_{p}" for stat in ("rms", "crest", "kurt", "skew", "max") for p in PHASES)},
            {', '.join(f"max(g.missing) FILTER (phase = '{p}') AS missing_ratio_{p}, max(g.n) FILTER (phase = '{p}') AS clean_length_{p}" for p in PHASES)},
            {', '.join(f"max(e.energy) FILTER (phase = '{p}') AS energy_{p}" for p in PHASES)}
            FROM ({stats_sql('smoothed')}) s
            JOIN (SELECT signal_id, window_no, phase, {r6('any_value(missing_count) / any_value(raw_count)')} AS missing, count(*) AS n
                  FROM smoothed GROUP BY 1, 2, 3) g USING (signal_id, window_no, phase)
            LEFT JOIN (SELECT signal_id, window_no, phase, {r6('sum(magnitude)')} AS energy FROM spectra WHERE n >= 20 GROUP BY 1, 2, 3) e
                USING (signal_id, window_no, phase) GROUP BY 1, 2""",
        CHUNKED + spectra_sql(PEAK_FFT).replace("FROM samples", "FROM chunked"),
    ),
)
def features_from_chunks(spark, sf_dir):
    """Stored chunks to feature rows, by array slices."""
    rows = X.features_from_chunks(
        _chunks(spark, sf_dir), SIZE, HOP, min_length=MIN_LENGTH, kernel=KERNEL, spectrum_size=PEAK_FFT)
    return rows.select(
        "signal_id", "window_no", "processed_phases", *[f"{stat}_{p}" for stat in ("rms", "crest", "kurt", "skew", "max") for p in PHASES],
        *[f"missing_ratio_{p}" for p in PHASES], *[F.col(f"clean_length_{p}").cast("bigint").alias(f"clean_length_{p}") for p in PHASES],
        *[F.col(f"phase_{p}.spectral_energy").alias(f"energy_{p}") for p in PHASES])
