"""Shared column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("a", "b", "c")
STATS = ("rms", "crest", "kurt", "skew", "mean", "std", "min", "max")
FEATURE_COLUMNS = tuple(f"{stat}_{phase}" for stat in STATS for phase in PHASES)

# fixed values: Abramowitz and Stegun 7.1.26, error below 2e-7
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a plain expression."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def present_count(columns: list[Column]) -> Column:
    total = F.lit(0)
    for column in columns:
        total = total + column.isNotNull().cast("int")
    return total


def mean_of_present(columns: list[Column]) -> Column:
    """Mean over the non-NULL columns, NULL when none is present."""
    total = F.lit(0.0)
    for column in columns:
        total = total + F.coalesce(column, F.lit(0.0))
    return F.try_divide(total, F.nullif(present_count(columns), F.lit(0)))


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """First label whose lower bound the value reaches (or exceeds, when strict)."""
    expression = None
    for bound, label in bands:
        hit = value > bound if strict else value >= bound
        expression = F.when(hit, F.lit(label)) if expression is None else expression.when(hit, F.lit(label))
    return expression.otherwise(F.lit(otherwise))


def present_phases(prefix: str, labels: tuple[str, ...] = ("A", "B", "C")) -> Column:
    """Array of the phase labels whose ``prefix_<phase>`` column is not NULL."""
    return F.array_compact(
        F.array(*[F.when(F.col(f"{prefix}_{p}").isNotNull(), F.lit(label)) for p, label in zip(PHASES, labels)])
    )
