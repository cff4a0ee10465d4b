"""Forest, components, scaling and the stored models."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlens.functions.expressions import FEATURE_COLUMNS
from motorlens.operators import forest as I
from motorlens.operators import matrix as M
from motorlens.operators import models as A


def planted(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(5, 0.5, (20, 3))])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>"), x


def test_forest_finds_planted_outliers(spark):
    df, _ = planted(spark)
    forest = I.fit_isolation_forest(df, contamination=0.1)
    found = {r["id"] for r in I.score_frame(df, forest).where("label = -1").collect()}
    assert 0.05 <= len(found) / 220 <= 0.15
    # a plain recursive forest written for comparison found 13 to 17 of the 20 on such data
    assert len([i for i in found if i >= 200]) >= 12


def test_path_lengths_equal_a_plain_walk(spark):
    df, x = planted(spark)
    forest = I.fit_isolation_forest(df, trees=5, contamination="auto")
    rows = df.select("id", forest.path_lengths(F.col("x")).alias("h")).collect()
    trees = {t: g.set_index("node") for t, g in forest.nodes.groupby("tree")}
    for row in rows[:20]:
        depths = []
        for nodes in trees.values():
            at = 0
            while nodes.loc[at, "feature"] >= 0:
                left = x[row["id"], int(nodes.loc[at, "feature"])] <= nodes.loc[at, "threshold"]
                at = nodes.loc[at, "left" if left else "right"]
            depths.append(nodes.loc[at, "depth"] + float(I.average_path(np.array([nodes.loc[at, "size"]]))[0]))
        assert abs(row["h"] - np.mean(depths)) < 1e-9


@pytest.mark.parametrize("n,trees", [(100, 10), (5_000, 10), (200_000, 10)])
def test_every_tree_draws_its_rows(spark, n, trees):
    df = spark.range(n).select("id", F.array(F.rand(1)).alias("x"))
    counts = [r["count"] for r in I.draw_samples(df, n, trees, 256, 42).groupBy("tree").count().collect()]
    assert counts == [min(n, 256)] * trees


def test_importance_sums_to_one(spark):
    df, _ = planted(spark)
    forest = I.fit_isolation_forest(df)
    rows = I.isolation_importance(forest.to_frame(spark), ["u", "v", "w"]).collect()
    assert abs(sum(r["importance"] for r in rows) - 1) < 1e-12 and len(rows) == 3


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) @ np.diag([3, 2, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    fitted = M.fit_pca(df, "x", 2)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:2])
    assert sum(fitted.explained) > 0.5
    assert np.allclose(np.abs(fitted.loadings), np.abs(vt[:2]))
    rows = fitted.transform(df, "x").orderBy("id").collect()
    assert np.allclose([[r["pc1"], r["pc2"]] for r in rows], centred @ np.array(fitted.loadings).T)


def feature_rows(spark, n=500, faults=0.2):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        broken = i < n * faults
        values = {c: rng.normal(10, 1) for c in FEATURE_COLUMNS}
        for p in "abc":
            if broken:
                values[f"rms_{p}"] += 15
                values[f"crest_{p}"] += 10
        if i % 10 == 0:
            values.update({c: None for c in FEATURE_COLUMNS if c.endswith("_c")})
        rows.append((f"f{i:04d}", *[None if values[c] is None else float(values[c]) for c in FEATURE_COLUMNS]))
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))


def test_training_on_realistic_faults_and_stored_models(spark, tmp_path):
    training = feature_rows(spark)
    models, scored = A.train_anomaly_models(training, contamination=0.2, eps=1.0, trees=50)
    assert models.summary["rows"] == 500
    assert 0.10 <= models.summary["forest_anomalies"] / 500 <= 0.30
    broken = scored.where("forest_label = -1 and id < 'f0100'").count()
    assert broken >= 80
    A.save_models(spark, models, str(tmp_path), datetime(2024, 1, 1))
    A.save_models(spark, models, str(tmp_path), datetime(2024, 1, 2))
    again = A.load_latest(spark, str(tmp_path))
    assert again.scaler == models.scaler
    first = {r["id"]: (r["decision"], r["cluster_label"]) for r in scored.collect()}
    for r in A.detect_anomalies(training, again).collect():
        assert abs(first[r["id"]][0] - r["decision"]) < 1e-9
        assert first[r["id"]][1] == r["cluster_label"]


def test_no_stored_models(spark, tmp_path):
    assert A.load_latest(spark, str(tmp_path / "nothing")) is None


def test_variance_selection_falls_back_to_ten(spark):
    df = spark.range(50).select("id", *[(F.lit(1.0) + F.col("id") * i * 1e-6).alias(f"c{i}") for i in range(12)])
    columns = [f"c{i}" for i in range(12)]
    assert len(M.select_by_variance(df, columns)) == 10
    assert M.select_by_variance(df.withColumn("c3", F.col("id") * 1.0), columns) == ["c3"]


def test_training_needs_a_hundred_rows(spark):
    features = spark.range(50).select("id", F.col("id").alias("raw_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("window_start"))
    signals = spark.range(50).select("id", F.lit(1).alias("equipment_id"))
    equipment = spark.createDataFrame([(1, "m")], "id int, name string")
    with pytest.raises(ValueError):
        M.training_frame(features, signals, equipment)


@pytest.mark.parametrize("phases", [3, 2, 1])
def test_vector_has_22_numbers(spark, phases):
    values = {f"{s}_{p}": (1.5 if i < phases else None) for s in ("rms", "crest", "kurt", "skew") for i, p in enumerate("abc")}
    schema = ", ".join(f"{c} double" for c in values) + ", " + ", ".join(
        f"peaks_{p} array<struct<frequency:double,amplitude:double,prominence:double>>" for p in "abc"
    )
    peaks = [(50.0, 3.0, 1.0), (100.0, 2.0, 1.0), (150.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*values.values(), None, peaks, None)], schema)
    vector = M.feature_vector22(df).first()["vector"]
    assert len(vector) == 22
    assert vector[12:18] == [50.0, 3.0, 100.0, 2.0, 150.0, 1.0] and vector[18:] == [0.0] * 4
    assert sum(v == 1.5 for v in vector[:12]) == 4 * phases
