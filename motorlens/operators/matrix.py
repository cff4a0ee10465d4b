"""From feature rows to a scaled matrix, principal components and model vectors.

Fitting is an action that brings a handful of numbers per column to the driver;
applying a fit is plain column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA as SparkPCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions.clock import floor_to
from motorlens.functions.expressions import PHASES
from motorlens.functions.quantiles import column_quantiles

# fixed values of the training
MIN_TRAINING_ROWS = 100
VARIANCE_THRESHOLD = 0.01
FALLBACK_COLUMNS = 10
VECTOR_LENGTH = 22
VECTOR_PEAKS = 5


def training_frame(
    features: DataFrame, signals: DataFrame, equipment: DataFrame, machine_ids: list | None = None,
    limit: int | None = None, min_rows: int = MIN_TRAINING_ROWS,
) -> DataFrame:
    """Feature rows with their machine, optionally of some machines and only the newest; too few rows are an error."""
    owner = signals.select(F.col("id").alias("raw_id"), "equipment_id")
    machine = equipment.select(F.col("id").alias("equipment_id"), F.col("name").alias("equipment_name"))
    if machine_ids is not None:
        owner = owner.where(F.col("equipment_id").isin(machine_ids))
    # the small sides meet first, so that feature rows are shuffled once
    rows = features.join(owner.join(machine, "equipment_id"), "raw_id")
    # rows are counted in any order, by their keys alone
    if (rows if limit is None else rows.limit(limit)).limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} feature rows to train on")
    if limit is not None:
        rows = rows.orderBy(F.col("window_start").desc(), "id").limit(limit)
    names = [c for c in features.columns if c != "raw_id"]
    return rows.select("equipment_id", "raw_id", *names, "equipment_name")


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: found[0.5] for c, found in column_quantiles(df, columns, [0.5]).items()}


def impute_median(df: DataFrame, columns: list[str], drop_empty: bool = False) -> tuple[DataFrame, list[str]]:
    """NULLs become the column's median; a column without values is dropped or set to 0."""
    medians = column_medians(df, columns)
    kept = [c for c in columns if c in medians] if drop_empty else columns
    filled = {c: F.coalesce(F.col(c), F.lit(medians.get(c, 0.0))) for c in kept}
    dropped = [c for c in columns if c not in kept]
    return df.withColumns(filled).drop(*dropped), kept


def column_variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def select_by_variance(df: DataFrame, columns: list[str], threshold: float = VARIANCE_THRESHOLD) -> list[str]:
    """Columns whose sample variance exceeds the threshold, else the ten that vary most."""
    variances = column_variances(df, columns)
    chosen = [c for c in columns if variances[c] > threshold]
    return chosen or sorted(columns, key=lambda c: -variances[c])[:FALLBACK_COLUMNS]


@dataclass(frozen=True)
class Scaler:
    """Fitted centre and width per column, with the medians that replace NULLs."""

    columns: list[str]
    medians: dict[str, float]
    centre: dict[str, float]
    width: dict[str, float]

    def scaled(self, column: str) -> Column:
        return (F.coalesce(F.col(column), F.lit(self.medians[column])) - self.centre[column]) / self.width[column]

    def transform(self, df: DataFrame, into: str | None = None) -> DataFrame:
        """Scaled columns in place, or one array column ``into``; new NULLs get the training medians."""
        if into:
            return df.withColumn(into, F.array(*[self.scaled(c) for c in self.columns]))
        return df.withColumns({c: self.scaled(c) for c in self.columns})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.medians[c], self.centre[c], self.width[c]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "position int, column string, median double, centre double, width double")

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        rows = df.orderBy("position").collect()
        return Scaler(
            [r["column"] for r in rows],
            *({r["column"]: r[field] for r in rows} for field in ("median", "centre", "width")),
        )


def fit_robust(df: DataFrame, columns: list[str]) -> Scaler:
    """Median and exact interquartile range; a zero range divides by 1."""
    found = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    medians = {c: found[c][0.5] if c in found else 0.0 for c in columns}
    width = {c: (found[c][0.75] - found[c][0.25] if c in found else 0.0) or 1.0 for c in columns}
    return Scaler(list(columns), medians, dict(medians), width)


def fit_standard(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> Scaler:
    """Mean and population deviation; a zero deviation divides by 1."""
    medians = medians if medians is not None else {c: 0.0 for c in columns}
    filled = [F.coalesce(F.col(c), F.lit(medians.get(c, 0.0))) for c in columns]
    row = df.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in zip(columns, filled)],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in zip(columns, filled)],
    ).first()
    return Scaler(
        list(columns),
        {c: medians.get(c, 0.0) for c in columns},
        {c: row[f"m_{c}"] or 0.0 for c in columns},
        {c: row[f"s_{c}"] or 1.0 for c in columns},
    )


@dataclass(frozen=True)
class Components:
    """Fitted principal components: mean (d), loadings (k x d) and explained shares (k)."""

    mean: list[float]
    loadings: list[list[float]]
    explained: list[float]

    def transform(self, df: DataFrame, column: str, prefix: str = "pc") -> DataFrame:
        out = df
        for k, loading in enumerate(self.loadings, start=1):
            weights = F.array(*[F.lit(float(w)) for w in loading])
            offset = float(np.dot(self.mean, loading))
            product = F.aggregate(
                F.zip_with(F.col(column), weights, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v
            )
            out = out.withColumn(f"{prefix}{k}", product - offset)
        return out


def fit_pca(df: DataFrame, column: str, k: int = 2) -> Components:
    """Components of an array column.  The data is centred first; each component's largest loading is positive."""
    width = df.select(F.size(column).alias("n")).first()["n"]
    row = df.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(width)]).first()
    mean = [row[f"m{i}"] for i in range(width)]
    centre = F.array(*[F.lit(m) for m in mean])
    vectors = df.select(array_to_vector(F.zip_with(column, centre, lambda x, m: x - m)).alias("v"))
    model = SparkPCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray().T
    signs = np.sign(loadings[np.arange(k), np.abs(loadings).argmax(axis=1)])
    return Components(mean, (loadings * signs[:, None]).tolist(), model.explainedVariance.toArray().tolist())


def pca_contributions(spark: SparkSession, components: Components, names: list[str]) -> DataFrame:
    """Absolute loading of every column per component, ranked."""
    rows = []
    for k, loading in enumerate(components.loadings, start=1):
        ranked = sorted(zip(names, np.abs(loading)), key=lambda item: (-item[1], item[0]))
        rows += [(f"PC{k}", rank, name, float(value)) for rank, (name, value) in enumerate(ranked, start=1)]
    return spark.createDataFrame(rows, "component string, rank int, feature string, contribution double")


def feature_vector22(features: DataFrame, peaks: tuple[str, ...] = ("peaks_a", "peaks_b", "peaks_c")) -> DataFrame:
    """12 statistics (0 when missing) and the 5 strongest peaks of the first phase that has any, padded to 22."""
    statistics = [F.coalesce(F.col(f"{s}_{p}").cast("double"), F.lit(0.0)) for s in ("rms", "crest", "kurt", "skew") for p in PHASES]
    available = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in peaks])
    top = F.slice(available, 1, VECTOR_PEAKS)
    flat = F.coalesce(
        F.flatten(F.transform(top, lambda p: F.array(p["frequency"], p["amplitude"]))), F.array().cast("array<double>")
    )
    padding = F.array_repeat(F.lit(0.0), F.lit(2 * VECTOR_PEAKS) - F.size(flat))
    return features.withColumn("vector", F.concat(F.array(*statistics), flat, padding))


def anomaly_rate_by_hour(scored: DataFrame) -> DataFrame:
    """Share of anomalies of both models per hour; ``scored`` has ``window_start, forest_label, cluster_label``."""
    forest, cluster = F.count_if(F.col("forest_label") == -1), F.count_if(F.col("cluster_label") == -1)
    n = F.count(F.lit(1))
    return scored.groupBy(floor_to("hour", "window_start").alias("hour")).agg(
        forest.alias("anomalies_forest"), n.alias("total_samples"), cluster.alias("anomalies_cluster"),
        (forest / n).alias("anomaly_rate_forest"), (cluster / n).alias("anomaly_rate_cluster"),
    )
