"""Data-quality rules over recordings and stored tables.

Rule frames are ``(signal_id, phase, severity, rule, measured)``.  All per-phase
rules read one profile, so a recording is aggregated once whatever is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions.expressions import PHASES
from motorlens.operators.reports import stack
from motorlens.session import materialise


@dataclass(frozen=True)
class Limits:
    """Fixed values of the validation."""

    min_rate: int = 1000
    max_rate: int = 100_000
    min_length: int = 100
    soft_length: tuple[int, int] = (3, 10)
    missing_critical: float = 0.8
    missing_warning: float = 0.1
    max_amplitude: float = 1000.0
    flat_share: float = 0.01


DEFAULTS = Limits()


def _rows(df: DataFrame, rules: list[Column], phase: Column) -> DataFrame:
    issues = F.array_compact(F.array(*rules))
    return df.select("signal_id", phase.alias("phase"), F.inline(issues))


def _issue(condition: Column, severity: Column | str, rule: str, measured: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        condition, F.struct(level.alias("severity"), F.lit(rule).alias("rule"), measured.cast("double").alias("measured"))
    )


def check_sample_rate(signals: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    rate = F.col("sample_rate_hz")
    signals = signals.withColumnRenamed("id", "signal_id")
    rules = [
        _issue(rate < limits.min_rate, "error", "sample_rate_low", rate),
        _issue(rate > limits.max_rate, "warning", "sample_rate_high", rate),
    ]
    return _rows(signals, rules, F.lit(None).cast("string"))


def phase_profile(samples: DataFrame) -> DataFrame:
    """Counts and moments per recording and phase; every aggregate is combined map-side."""
    v = F.col("value")
    return samples.groupBy("signal_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.max(F.abs(v)).alias("amplitude"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
    )


def _length(limits: Limits) -> list[Column]:
    low, high = limits.soft_length
    severity = F.when(F.col("n").between(low, high), "warning").otherwise("error")
    return [_issue(F.col("n") < limits.min_length, severity, "length", F.col("n"))]


def _missing(limits: Limits) -> list[Column]:
    share = F.col("missing") / F.col("n")
    severity = F.when(share > limits.missing_critical, "critical").otherwise("warning")
    return [_issue(share > limits.missing_warning, severity, "missing", share)]


def _amplitude(limits: Limits) -> list[Column]:
    return [_issue(F.col("amplitude") > limits.max_amplitude, "error", "amplitude", F.col("amplitude"))]


def _flat(limits: Limits) -> list[Column]:
    return [_issue(F.col("std") < limits.flat_share * F.abs("mean"), "warning", "flatline", F.col("std"))]


def check_length(profile: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    return _rows(profile, _length(limits), F.col("phase"))


def check_missing(profile: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    return _rows(profile, _missing(limits), F.col("phase"))


def check_amplitude(profile: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    return _rows(profile, _amplitude(limits), F.col("phase"))


def check_flatline(profile: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    return _rows(profile, _flat(limits), F.col("phase"))


def check_phase_consistency(profile: DataFrame, signals: DataFrame) -> DataFrame:
    """Phases of different length are an error, a recording without any phase is critical."""
    per_signal = profile.groupBy("signal_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    joined = signals.select(F.col("id").alias("signal_id")).join(per_signal, "signal_id", "left")
    rules = [
        _issue(F.col("lo") != F.col("hi"), "error", "phase_lengths", F.col("hi") - F.col("lo")),
        _issue(F.col("hi").isNull(), "critical", "no_phases", F.lit(0)),
    ]
    return _rows(joined, rules, F.lit(None).cast("string"))


def validation_issues(samples: DataFrame, signals: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """All rules at once over one profile."""
    profile = phase_profile(samples)
    per_phase = [*_length(limits), *_missing(limits), *_amplitude(limits), *_flat(limits)]
    return stack(
        [
            check_sample_rate(signals, limits),
            _rows(profile, per_phase, F.col("phase")),
            check_phase_consistency(profile, signals),
        ]
    )


def validation_summary(issues: DataFrame, signals: DataFrame) -> DataFrame:
    """Issues per severity of every recording, and whether it passes."""
    severities = ("info", "warning", "error", "critical")
    counts = issues.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in severities],
    )
    return (
        signals.select(F.col("id").alias("signal_id"))
        .join(counts, "signal_id", "left")
        .fillna(0, subset=["total_issues", *severities])
        .withColumn("passes", (F.col("error") + F.col("critical")) == 0)
    )


def passing(frame: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows whose recording has neither errors nor critical issues."""
    failing = issues.where(F.col("severity").isin("error", "critical")).select("signal_id").distinct()
    # stored, so that its size is known and a hot recording can be split in the join
    return frame.join(materialise(failing), "signal_id", "left_anti")


def constraint_violations(table: DataFrame, kind: str) -> DataFrame:
    """Rows of a stored table that break a table rule, as ``(id, constraint)``."""
    rules: dict[str, dict[str, Column]] = {
        "signals": {
            "positive_sample_rate": F.col("sample_rate_hz") > 0,
            "positive_samples_count": F.col("samples_count") > 0,
            "has_phase": F.col("has_a") | F.col("has_b") | F.col("has_c"),
        },
        "features": {
            "window_order": F.col("window_end") > F.col("window_start"),
            **{f"rms_{p}_not_negative": F.coalesce(F.col(f"rms_{p}") >= 0, F.lit(True)) for p in PHASES},
        },
        "predictions": {
            "probability_range": F.col("probability").between(0, 1),
            "confidence_range": F.coalesce(F.col("confidence").between(0, 1), F.lit(True)),
        },
    }
    if kind not in rules:
        raise ValueError(f"no table rules for {kind!r}")
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules[kind].items()]))
    return table.select("id", F.explode(broken).alias("constraint"))


def features_usable(features: DataFrame) -> DataFrame:
    """At least two of the four phase-a statistics are present."""
    present = sum((F.col(f"{s}_a").isNotNull().cast("int") for s in ("rms", "crest", "kurt", "skew")), F.lit(0))
    return features.withColumn("usable", present >= 2)
