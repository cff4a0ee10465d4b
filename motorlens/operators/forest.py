"""Isolation forest: samples drawn by Spark, one small tree per group, scoring in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.quantiles import exact_quantiles
from motorlens.functions.shipping import by_value
from motorlens.session import materialise

by_value(__name__)

# fixed values of the forest
TREES = 100
TREE_ROWS = 256
SEED = 42
CONTAMINATION = 0.1
AUTO_OFFSET = -0.5
EULER = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    depth = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, depth))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, int, int]]:
    """Nodes ``(feature, threshold, left, right, size, depth)``; a leaf has feature -1."""
    limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    nodes: list[tuple[int, float, int, int, int, int]] = []
    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop()
        index = len(nodes)
        if parent >= 0:
            f, t, left, right, size, d = nodes[parent]
            nodes[parent] = (f, t, left, index, size, d) if is_right else (f, t, index, right, size, d)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((-1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(varying))
        # strictly below the highest value, so that both sides keep a row
        threshold = float(min(rng.uniform(low[feature], high[feature]), np.nextafter(high[feature], low[feature])))
        below = x[rows, feature] <= threshold
        nodes.append((feature, threshold, -1, -1, len(rows), depth))
        pending.append((rows[~below], depth + 1, index, True))
        pending.append((rows[below], depth + 1, index, False))
    return nodes


def draw_samples(df: DataFrame, n: int, trees: int, rows: int, seed: int, slack: float = 3.0) -> DataFrame:
    """``rows`` input rows for every tree, chosen by seeded hashes.

    Every row enters every tree with the same chance, independently, whatever the size of
    the input.  One hash finds the first tree a row enters, if any, by the length of its
    run of misses; only rows that enter one are hashed for the trees after it.
    """
    rate = min(1.0, slack * rows / max(n, 1))

    def ticket(salt: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.col("id"), salt, F.lit(seed)), 11) / F.lit(float(2**53))

    every = F.sequence(F.lit(0), F.lit(trees - 1))
    if rate < 1.0:
        misses = F.floor(F.log1p(-ticket(F.lit(-1))) / math.log1p(-rate))
        entered = df.select("id", "x", misses.alias("_first")).where(F.col("_first") < trees)
        drawn = F.filter(every, lambda t: (t == F.col("_first")) | ((t > F.col("_first")) & (ticket(t) < rate)))
    else:
        entered, drawn = df, every
    copies = entered.select("id", "x", F.explode(drawn).alias("tree"))
    order = Window.partitionBy("tree").orderBy(ticket(F.col("tree")), "id")
    return copies.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).drop("_rank")


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees (a few hundred per tree) and the decision offset."""

    nodes: pd.DataFrame
    tree_rows: int
    offset: float

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def path_lengths(self, column: Column) -> Column:
        """Mean path length of an array column over all trees."""
        trees = [
            tuple(group[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth"))
            for _, group in self.nodes.sort_values(["tree", "node"]).groupby("tree")
        ]

        @F.pandas_udf("double")
        def kernel(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=float)
            x = np.stack([np.asarray(v, dtype=float) for v in batch])
            row = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, size, depth in trees:
                at = np.zeros(len(x), dtype=int)
                inner = feature[at] >= 0
                while inner.any():
                    go_left = x[row, np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                    inner = feature[at] >= 0
                total += depth[at] + average_path(size[at])
            return pd.Series(total / len(trees))

        return kernel(column)


def grow_forest(df: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> tuple[pd.DataFrame, int]:
    """Nodes of all trees and the rows per tree."""
    n = df.count()
    if n == 0:
        raise ValueError("no rows to train on")
    expected = min(n, tree_rows)

    def build(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = grow_tree(np.stack([np.asarray(v, dtype=float) for v in rows["x"]]), rng)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    slack = 3.0
    while True:
        samples = draw_samples(df, n, trees, tree_rows, seed, slack)
        nodes = samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        roots = nodes[nodes["node"] == 0]
        # the drawn share is random; draw wider in the rare case a tree came out short
        if len(roots) == trees and (roots["size"] == expected).all():
            return nodes, expected
        slack *= 4


def score_frame(df: DataFrame, forest: Forest, column: str = "x") -> DataFrame:
    """Adds ``score`` (lower is stranger), ``decision`` and ``label`` (-1 anomaly, 1 normal)."""
    scale = float(average_path(np.array([forest.tree_rows]))[0]) or 1.0
    score = -F.pow(F.lit(2.0), -forest.path_lengths(F.col(column)) / scale)
    return (
        df.withColumn("score", score)
        .withColumn("decision", F.col("score") - F.lit(forest.offset))
        .withColumn("label", F.when(F.col("decision") < 0, -1).otherwise(1))
    )


def fit_isolation_forest(
    df: DataFrame, trees: int = TREES, contamination: float | str = CONTAMINATION, seed: int = SEED,
    tree_rows: int = TREE_ROWS,
) -> Forest:
    """Forest over ``(id, x ARRAY<DOUBLE>)``; the cut is the contamination quantile of the training scores, or fixed."""
    nodes, rows = grow_forest(df, trees, tree_rows, seed)
    open_forest = Forest(nodes, rows, AUTO_OFFSET)
    if contamination == "auto":
        return open_forest
    # stored, because the quantile reads the scores more than once
    scores = materialise(score_frame(df, open_forest).select("score"))
    offset = exact_quantiles(scores, [], "score", [float(contamination)]).first()["quantile"]
    return Forest(nodes, rows, offset)


def isolation_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Share of each feature in the splits, weighted by the rows a split separates; shares sum to 1."""
    splits = nodes.where(F.col("feature") >= 0).groupBy("feature").agg(F.sum("size").alias("weight"))
    total = splits.agg(F.sum("weight")).scalar()
    labels = F.array(*[F.lit(n) for n in names])
    every = nodes.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("feature"))
    return every.join(splits, "feature", "left").select(
        F.element_at(labels, F.col("feature") + 1).alias("feature"),
        (F.coalesce("weight", F.lit(0)) / total).alias("importance"),
    )
