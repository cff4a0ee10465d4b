"""Training, applying and storing the anomaly models."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS
from motorlens.operators import clusters as C
from motorlens.operators import forest as I
from motorlens.operators import matrix as M
from motorlens.operators import metric as N
from motorlens.session import materialise

# fixed values of the stored predictions
MODEL_NAME = "ensemble_anomaly_detection"
MODEL_VERSION = "1.0.0"
MODEL_TYPE = "anomaly_ensemble"
NOISE_CONFIDENCE = 0.8
FORECAST_ABOVE = 0.7


@dataclass(frozen=True)
class AnomalyModels:
    """Everything scoring needs: small fits as objects, the core points of the clusters as a frame."""

    scaler: M.Scaler
    components: M.Components
    forest: I.Forest
    core_points: DataFrame
    eps: float
    min_samples: int
    summary: dict


def train_anomaly_models(
    training: DataFrame, columns: list[str] | None = None, contamination: float | str = I.CONTAMINATION,
    trees: int = I.TREES, eps: float = C.EPS, min_samples: int = C.MIN_SAMPLES, components: int = 2, seed: int = I.SEED,
) -> tuple[AnomalyModels, DataFrame]:
    """Impute, select, scale, then forest, components and clusters; returns the models and the scored rows.

    ``training`` has a unique ``id`` and the feature columns.  The clusters live on
    all selected columns of the scaled matrix.
    """
    columns = list(columns or FEATURE_COLUMNS)
    # the fits below scan the rows several times; their joins and features run once
    training = materialise(training.select("id", *_kept(training), *columns))
    medians = M.column_medians(training, columns)
    filled = training.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c, 0.0))) for c in columns})
    selected = M.select_by_variance(filled, columns)
    robust = M.fit_robust(filled, selected)
    scaler = M.Scaler(selected, {c: medians.get(c, 0.0) for c in selected}, robust.centre, robust.width)
    # the scaled matrix feeds every model, so it is computed once
    scaled = materialise(
        scaler.transform(training, into="x").select("id", "x", *_kept(training))
    )
    forest = I.fit_isolation_forest(scaled.select("id", "x"), trees, contamination, seed)
    fitted = M.fit_pca(scaled, "x", components)
    coords = [f"pc{k}" for k in range(1, components + 1)]
    projected = materialise(fitted.transform(I.score_frame(scaled, forest), "x"))
    points = projected.select("id", "x")
    labels, used_eps, used_samples = N.dbscan_relaxed(points, "x", eps, min_samples)
    core = materialise(
        labels.where("is_core").select("id", "label").join(points, "id")
    )
    scored = _scored(projected, labels, training, coords)
    totals = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("forest_label") == -1).alias("forest_anomalies"),
        F.count_if(F.col("cluster_label") == -1).alias("cluster_noise"),
        F.count_distinct(F.when(F.col("cluster_label") == 1, F.col("cluster"))).alias("clusters"),
    ).first().asDict()
    totals["explained"] = sum(fitted.explained)
    models = AnomalyModels(scaler, fitted, forest, core, used_eps, used_samples, totals)
    return models, scored


def _kept(training: DataFrame) -> list[str]:
    return [c for c in ("raw_id", "equipment_id", "window_start") if c in training.columns]


def _scored(projected: DataFrame, labels: DataFrame, training: DataFrame, coords: list[str]) -> DataFrame:
    clusters = labels.select("id", F.col("label").alias("cluster"), "is_core")
    noise = F.col("cluster") == C.noise_label(labels, "label")
    forest = projected.withColumnRenamed("label", "forest_label")
    return forest.join(clusters, "id").select(
        "id", *_kept(training), "x", "score", "decision", "forest_label", "cluster", "is_core",
        F.when(noise, -1).otherwise(1).alias("cluster_label"), *coords,
    )


def combine_labels(scored: DataFrame) -> DataFrame:
    """One prediction per row from ``forest_label, decision, cluster_label``."""
    by_forest, by_cluster = F.col("forest_label") == -1, F.col("cluster_label") == -1
    confidence = F.greatest(
        F.when(by_forest, F.abs("decision")).otherwise(0.0), F.when(by_cluster, F.lit(NOISE_CONFIDENCE)).otherwise(0.0)
    )
    return (
        scored.withColumn("anomaly_detected", by_forest | by_cluster)
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
        .withColumn("wants_forecast", F.col("anomaly_detected") & (F.col("confidence") > FORECAST_ABOVE))
        .withColumn("model_name", F.lit(MODEL_NAME))
        .withColumn("model_version", F.lit(MODEL_VERSION))
        .withColumn("model_type", F.lit(MODEL_TYPE))
    )


def detect_anomalies(features: DataFrame, models: AnomalyModels) -> DataFrame:
    """Predictions for new feature rows: forest score, nearest clusters, combined label."""
    scored = I.score_frame(models.scaler.transform(features, into="x"), models.forest).withColumnRenamed(
        "label", "forest_label"
    )
    stored = materialise(scored.select("id", *_kept(features), "score", "decision", "forest_label", "x"))
    assigned = N.assign_to_clusters(stored.select("id", "x"), models.core_points, "x", models.eps)
    noise = F.col("cluster") == C.noise_label(models.core_points, "label")
    labelled = stored.join(assigned.withColumnRenamed("label", "cluster"), "id").withColumn(
        "cluster_label", F.when(noise, -1).otherwise(1)
    )
    return combine_labels(labelled).drop("x")


def save_models(spark: SparkSession, models: AnomalyModels, path: str, moment: datetime) -> str:
    """A versioned folder per training, plus one line in the manifest table."""
    version = f"v1.0.0_{moment:%Y%m%d_%H%M%S}"
    folder = f"{path.rstrip('/')}/version={version}"
    models.scaler.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/scaler")
    models.forest.to_frame(spark).write.mode("overwrite").parquet(f"{folder}/forest")
    models.core_points.write.mode("overwrite").parquet(f"{folder}/core_points")
    parameters = {
        "tree_rows": models.forest.tree_rows, "offset": models.forest.offset, "eps": models.eps,
        "min_samples": models.min_samples, "mean": models.components.mean, "loadings": models.components.loadings,
        "explained": models.components.explained, "summary": models.summary,
    }
    row = [(version, moment, len(models.scaler.columns), int(models.summary["rows"]), json.dumps(parameters))]
    schema = "version string, updated_at timestamp, n_features int, n_rows bigint, parameters string"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return version


def load_latest(spark: SparkSession, path: str) -> AnomalyModels | None:
    """The newest stored models, None when there are none."""
    root = path.rstrip("/")
    try:
        manifest = spark.read.parquet(f"{root}/manifest")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    newest = manifest.agg(F.max_by(F.struct("version", "parameters"), F.struct("updated_at", "version")).alias("m")).first()["m"]
    if newest is None:
        return None
    parameters = json.loads(newest["parameters"])
    folder = f"{root}/version={newest['version']}"
    nodes = spark.read.parquet(f"{folder}/forest").toPandas()
    return AnomalyModels(
        M.Scaler.from_frame(spark.read.parquet(f"{folder}/scaler")),
        M.Components(parameters["mean"], parameters["loadings"], parameters["explained"]),
        I.Forest(nodes, parameters["tree_rows"], parameters["offset"]),
        spark.read.parquet(f"{folder}/core_points"),
        parameters["eps"],
        parameters["min_samples"],
        parameters["summary"],
    )


def retrain(spark: SparkSession, training: DataFrame, path: str, moment: datetime, **options) -> tuple[str, dict]:
    """Train on everything given, store the models, return the version and the summary."""
    models, _ = train_anomaly_models(training, **options)
    return save_models(spark, models, path, moment), models.summary
