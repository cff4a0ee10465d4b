"""Hot keys: same results, and no plan that gathers a hot key in one task."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motorlens import session
from motorlens.functions import quantiles
from motorlens.functions.ordering import position_within, running_total
from motorlens.functions.quantiles import column_quantiles, exact_quantiles
from motorlens.operators import clusters as C
from motorlens.operators import forest


def hot_rows(spark, n=30_000):
    """A third of all rows belong to key 0."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    return spark.range(n).select(
        key.alias("k"), F.timestamp_add("SECOND", F.col("id") * 7 % 5000, F.lit("2024-01-01").cast("timestamp_ntz"))
        .cast("timestamp_ntz").alias("ts"), "id", (F.hash("id") % 1000 / 7).alias("v"),
    )


def test_positions_and_totals_equal_plain_windows(spark):
    df = hot_rows(spark)
    order = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("p", F.row_number().over(order) - 1).withColumn("s", F.sum(F.col("id")).over(order))
    split = running_total(position_within(df, ["k"], "ts", ["id"], "p2"), ["k"], "ts", ["id"], "id", "s2")
    joined = plain.join(split.select("id", "p2", "s2"), "id")
    assert joined.count() == df.count()
    assert joined.where("p != p2 or s != s2").count() == 0


def test_exact_quantiles_with_a_hot_key_and_ties(spark):
    df = hot_rows(spark, 60_000).withColumn("v", F.when(F.col("id") % 5 == 0, F.lit(3.25)).otherwise(F.col("v")))
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    expected = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    for row in expected:
        for p, q in zip(probs, row["q"]):
            assert abs(found[row["k"], p] - q) < 1e-9
    assert len(found) == len(expected) * len(probs)


def test_exact_quantiles_without_keys_match_numpy(spark):
    df = hot_rows(spark, 50_000)
    values = np.array([r["v"] for r in df.select("v").collect()])
    for row in exact_quantiles(df, [], "v", [0.1, 0.5, 0.999]).collect():
        assert abs(row["quantile"] - np.quantile(values, row["prob"])) < 1e-9


def test_column_quantiles_match_numpy(spark):
    df = hot_rows(spark, 50_000).select("v", (F.col("v") ** 2).alias("w"), F.lit(None).cast("double").alias("none"),
                                        F.when(F.col("id") < 10, F.col("v")).alias("few"))
    found = column_quantiles(df, ["v", "w", "none", "few"], [0.25, 0.5, 0.75])
    assert "none" not in found
    local = df.toPandas()
    for c in ("v", "w", "few"):
        for p, q in found[c].items():
            assert abs(q - np.quantile(local[c].dropna(), p)) < 1e-6


def brute(x, eps, m):
    near = ((x[:, None, :] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                for v in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[v] = i
                    stack.append(v)
    for i in np.flatnonzero(~core):
        touching = label[near[i] & core]
        if len(touching):
            label[i] = touching.min()
    return label, core


def test_clusters_equal_brute_force_with_hot_cells(spark):
    rng = np.random.default_rng(7)
    x = np.vstack(
        [np.repeat([[0.0, 0.0]], 300, 0), np.repeat([[0.1000001, 0.0]], 100, 0), np.repeat([[0.19, 0.0]], 100, 0),
         rng.normal(1, 0.1, (150, 2)), rng.uniform(-0.5, 2, (150, 2))]
    )
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    out = C.dbscan(df, ["x", "y"], 0.1, 5).toPandas().sort_values("id")
    label, core = brute(x, 0.1, 5)
    assert (out["label"].to_numpy() == label).all()
    assert (out["is_core"].to_numpy() == core).all()


def test_hot_cell_is_not_paired_with_itself(spark):
    """Compared pairs stay linear: copies of one point need no comparison at all."""
    n = 20_000
    df = spark.range(n).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    grid = C._Grid(["x", "y"], 0.5)
    placed = grid.placed(df)
    cells = placed.groupBy(*grid.cell).agg(F.count(F.lit(1)).alias("_n"))
    assert C._sparse_matches(grid, placed.join(cells, grid.cell), cells, 5).count() == 0


def test_text_ids_and_components(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200) if i != 100], "u string, v string")
    found = {r["node"]: r["component"] for r in C.connected_components(edges).collect()}
    assert found["n0100"] == "n0000" and found["n0200"] == "n0101" and len(found) == 201


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_a_missed_bracket_is_opened(spark, monkeypatch, keys):
    """With no margin around a rough sketch ranks fall outside their brackets; one value lies far out."""
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    values = [float(i * i % 7919) for i in range(5000)] + [1e12]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(6)
    found = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, keys, "v", [0.1, 0.5, 0.999]).collect()}
    for p, q in found.items():
        assert abs(q - np.quantile(values, p)) < 1e-6
    if not keys:
        columns = quantiles.column_quantiles(df, ["v"], [0.1, 0.5, 0.999])["v"]
        assert all(abs(columns[p] - q) < 1e-6 for p, q in found.items())


def test_every_row_enters_a_tree_with_the_same_chance(spark):
    df = spark.range(20_000).select("id", F.array(F.lit(0.0)).alias("x"))
    for trees in (5, 200):
        per_tree = [r["n"] for r in forest.draw_samples(df, 20_000, trees, 10_000, 7, slack=0.02).groupBy("tree").agg(F.count("*").alias("n")).collect()]
        assert len(per_tree) == trees and abs(np.mean(per_tree) - 200) < 200 / np.sqrt(trees) + 5
        assert 8 < np.std(per_tree) < 22


def test_written_tables_can_be_dropped(spark):
    kept = session.materialise(spark.range(3))
    assert kept.count() == 3 and session.drop_tables(spark) >= 1
    assert session.drop_tables(spark) == 0
