"""Exact density clustering on up to three coordinates without comparing all pairs.

Cells have a diagonal of ``eps``, so points of one cell are neighbours of each
other.  A cell with ``min_samples`` points needs no distances at all: its points
are core points and one component.  Distances are computed only for points of
sparser cells, of which a cell holds fewer than ``min_samples``, so the number of
compared pairs grows linearly.  Two full cells are tested by bounding boxes that
are halved until the answer is certain.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.operators.reports import stack
from motorlens.session import materialise

# fixed values of the clustering
EPS = 0.5
MIN_SAMPLES = 5
RELAXED_EPS = 1.5
RELAXED_SAMPLES = 0.5

NOISE = -1
# rows of one cell that one task compares against that cell's lookups
SALT_ROWS = 20_000


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def noise_label(df: DataFrame, column: str) -> Column:
    return F.lit(NOISE).cast(df.schema[column].dataType)


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cell steps whose cells can hold points within one diagonal of each other."""
    reach = math.ceil(math.sqrt(d)) + 1
    steps = itertools.product(range(-reach, reach + 1), repeat=d)
    return [o for o in steps if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an edge list ``(u, v)``; the component is its smallest node.

    Alternates the two star operations: neighbours are linked to the smallest
    neighbour until every component is one star, in few rounds whatever the diameter.
    """

    def minimum(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def fingerprint(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialise(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(minimum(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        hooked = large.join(minimum(large), "u")
        small = (
            hooked.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(hooked.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = materialise(small)
        after = fingerprint(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


class _Grid:
    """Column helpers for one choice of coordinates and eps."""

    def __init__(self, coords: list[str], eps: float):
        if not 1 <= len(coords) <= 3:
            raise ValueError("clustering works on one to three coordinates; reduce the matrix first")
        self.coords, self.eps, self.d = coords, eps, len(coords)
        # a hair below the exact side, so that rounding cannot push a cell's diagonal over eps
        self.side = eps / math.sqrt(self.d) * (1 - 1e-12)
        self.cell = [f"_c{i}" for i in range(self.d)]
        self.offsets = _offsets(self.d)

    def index(self, i: int, level: int = 0) -> Column:
        return F.floor(F.col(self.coords[i]) / F.lit(self.side / 2**level)).cast("bigint")

    def placed(self, points: DataFrame) -> DataFrame:
        return points.select("id", *self.coords, *[self.index(i).alias(c) for i, c in enumerate(self.cell)])

    def around(self) -> Column:
        steps = [F.struct(*[F.lit(v).cast("bigint").alias(f"o{i}") for i, v in enumerate(o)]) for o in self.offsets]
        return F.explode(F.array(*steps))

    def near(self, left: str, right: str) -> Column:
        squares = [(F.col(f"{left}{c}") - F.col(f"{right}{c}")) ** 2 for c in self.coords]
        return _total(squares) <= self.eps * self.eps


def _sparse_matches(grid: _Grid, points: DataFrame, cells: DataFrame, min_samples: int) -> DataFrame:
    """For every point of a sparse cell: how many points of each cell are its neighbours.

    Neighbours in sparse cells stay listed one by one (``q``), those in full cells only as a count.
    """
    salts = F.ceil(F.col("_n") / SALT_ROWS)
    lookups = points.where(F.col("_n") < min_samples).select(
        F.col("id").alias("p"), *[F.col(c).alias(f"p_{c}") for c in grid.coords],
        *[F.col(c).alias(f"p{c}") for c in grid.cell], grid.around().alias("_o"),
    )
    lookups = lookups.withColumns({c: F.col(f"p{c}") + F.col(f"_o.o{i}") for i, c in enumerate(grid.cell)}).drop("_o")
    lookups = lookups.join(cells, grid.cell).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    targets = points.select(
        F.col("id").alias("q"), *[F.col(c).alias(f"q_{c}") for c in grid.coords], *grid.cell,
        F.pmod(F.xxhash64("id"), salts).cast("int").alias("_salt"),
    )
    matched = lookups.join(targets, [*grid.cell, "_salt"]).where(grid.near("p_", "q_"))
    full = F.col("_n") >= min_samples
    return matched.groupBy(
        "p", *[f"p{c}" for c in grid.cell], *grid.cell, full.alias("full"), F.when(~full, F.col("q")).alias("q")
    ).agg(F.count(F.lit(1)).alias("neighbours"))


def _boxes(grid: _Grid, points: DataFrame, level: int, side: str) -> DataFrame:
    """Bounding boxes of the sub-cells of one level."""
    sub = [grid.index(i, level).alias(f"{side}s{i}") for i in range(grid.d)]
    cell = [F.col(c).alias(f"{side}{c}") for c in grid.cell]
    bounds = [F.min(c).alias(f"{side}lo{i}") for i, c in enumerate(grid.coords)]
    bounds += [F.max(c).alias(f"{side}hi{i}") for i, c in enumerate(grid.coords)]
    return points.groupBy(*cell, *sub).agg(*bounds)


def _full_cell_edges(grid: _Grid, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of the given cell pairs hold two points within eps.

    ``pairs`` has cell columns ``a_c*`` and ``b_c*``.  Boxes that are certainly
    near or certainly apart are settled; the others are halved.  A box of one
    distinct point is always settled, so the loop ends.
    """
    a_cell, b_cell = [f"a{c}" for c in grid.cell], [f"b{c}" for c in grid.cell]
    apart = _total(
        [
            F.greatest(F.lit(0.0), F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}")) ** 2
            for i in range(grid.d)
        ]
    )
    reach = _total(
        [
            F.greatest(F.abs(F.col(f"bhi{i}") - F.col(f"alo{i}")), F.abs(F.col(f"ahi{i}") - F.col(f"blo{i}"))) ** 2
            for i in range(grid.d)
        ]
    )
    limit = F.lit(grid.eps * grid.eps)
    found: list[DataFrame] = []
    open_pairs, level = pairs, 0
    while True:
        keys = [*a_cell, *b_cell]
        involved = open_pairs.select(*[F.col(f"a{c}").alias(c) for c in grid.cell]).unionByName(
            open_pairs.select(*[F.col(f"b{c}").alias(c) for c in grid.cell])
        ).distinct()
        inside = points.join(involved, grid.cell, "left_semi")
        left, right = _boxes(grid, inside, level, "a"), _boxes(grid, inside, level, "b")
        a_keys, b_keys = list(a_cell), list(b_cell)
        if level > 0:
            for i in range(grid.d):
                left = left.withColumn(f"_ap{i}", F.floor(F.col(f"as{i}") / 2).cast("bigint"))
                right = right.withColumn(f"_bp{i}", F.floor(F.col(f"bs{i}") / 2).cast("bigint"))
            parents = {f"as{i}": f"_ap{i}" for i in range(grid.d)} | {f"bs{i}": f"_bp{i}" for i in range(grid.d)}
            open_pairs = open_pairs.withColumnsRenamed(parents)
            a_keys += [f"_ap{i}" for i in range(grid.d)]
            b_keys += [f"_bp{i}" for i in range(grid.d)]
        boxed = open_pairs.join(left, a_keys).join(right, b_keys)
        judged = materialise(
            boxed.where(apart <= limit).select(
                *keys, *[f"as{i}" for i in range(grid.d)], *[f"bs{i}" for i in range(grid.d)], (reach <= limit).alias("_near")
            )
        )
        near = judged.where("_near").select(*keys).distinct()
        found.append(near)
        open_pairs = judged.where(~F.col("_near")).drop("_near").join(near, keys, "left_anti")
        if open_pairs.isEmpty():
            return stack(found)
        level += 1


def dbscan(points: DataFrame, coords: list[str], eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``(id, label, is_core)``: the label is the smallest core id of the cluster, -1 is noise.

    A border point within reach of several clusters takes the smallest label.
    ``points`` has a unique ``id``, a number or text, and the coordinate columns;
    labels have the type of the id.
    """
    grid = _Grid(coords, eps)
    placed = grid.placed(points)
    cells = placed.groupBy(*grid.cell).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialise(placed.join(cells, grid.cell))
    matches = materialise(_sparse_matches(grid, counted, cells, min_samples))
    p_cell = [f"p{c}" for c in grid.cell]

    sparse_core = (
        matches.groupBy("p", *p_cell).agg(F.sum("neighbours").alias("n")).where(F.col("n") >= min_samples).select("p", *p_cell)
    )
    full_points = counted.where(F.col("_n") >= min_samples)
    core = full_points.select("id", *grid.cell).unionByName(
        sparse_core.select(F.col("p").alias("id"), *[F.col(f"p{c}").alias(c) for c in grid.cell])
    )
    nodes = materialise(core.groupBy(*grid.cell).agg(F.min("id").alias("node")))

    # edges between cells with core points
    core_rows = matches.join(sparse_core.select("p"), "p", "left_semi")
    to_full = core_rows.where("full").select(*p_cell, *grid.cell)
    to_sparse = (
        core_rows.where(~F.col("full"))
        .join(sparse_core.select(F.col("p").alias("q")), "q", "left_semi")
        .select(*p_cell, *grid.cell)
    )
    full_cells = cells.where(F.col("_n") >= min_samples).select(*grid.cell)
    forward = [o for o in grid.offsets if o > tuple([0] * grid.d)]
    steps = F.explode(
        F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"o{i}") for i, v in enumerate(o)]) for o in forward])
    )
    a_full = full_cells.select(*[F.col(c).alias(f"a{c}") for c in grid.cell], steps.alias("_o"))
    a_full = a_full.withColumns({f"b{c}": F.col(f"a{c}") + F.col(f"_o.o{i}") for i, c in enumerate(grid.cell)}).drop("_o")
    b_full = full_cells.select(*[F.col(c).alias(f"b{c}") for c in grid.cell])
    pairs = materialise(a_full.join(b_full, [f"b{c}" for c in grid.cell]))
    full_edges = _full_cell_edges(grid, full_points, pairs)

    def as_nodes(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
        u = nodes.select(*[F.col(c).alias(n) for c, n in zip(grid.cell, left)], F.col("node").alias("u"))
        v = nodes.select(*[F.col(c).alias(n) for c, n in zip(grid.cell, right)], F.col("node").alias("v"))
        return rows.distinct().join(u, left).join(v, right).select("u", "v")

    edges = as_nodes(to_full.unionByName(to_sparse), p_cell, grid.cell).unionByName(
        as_nodes(full_edges, [f"a{c}" for c in grid.cell], [f"b{c}" for c in grid.cell])
    )
    component = connected_components(edges)
    labelled = materialise(
        nodes.join(component, "node", "left").select(*grid.cell, F.coalesce("component", "node").alias("label"))
    )

    core_labels = core.join(labelled, grid.cell).select("id", "label", F.lit(True).alias("is_core"))
    border = matches.join(sparse_core.select("p"), "p", "left_anti")
    touching = border.where("full").unionByName(
        border.where(~F.col("full")).join(sparse_core.select(F.col("p").alias("q")), "q", "left_semi").select(border.columns)
    )
    border_labels = (
        touching.join(labelled, grid.cell)
        .groupBy(F.col("p").alias("id"))
        .agg(F.min("label").alias("label"))
        .withColumn("is_core", F.lit(False))
    )
    known = core_labels.unionByName(border_labels)
    return counted.select("id").join(known, "id", "left").select(
        "id", F.coalesce("label", noise_label(points, "id")).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def dbscan_relaxed(
    points: DataFrame, coords: list[str], eps: float = EPS, min_samples: int = MIN_SAMPLES
) -> tuple[DataFrame, float, int]:
    """Clusters, and where there are none once more with a wider eps and fewer points; also the values used."""
    labels = materialise(dbscan(points, coords, eps, min_samples))
    if not labels.where("is_core").isEmpty():
        return labels, eps, min_samples
    eps, min_samples = eps * RELAXED_EPS, max(2, int(min_samples * RELAXED_SAMPLES))
    return materialise(dbscan(points, coords, eps, min_samples)), eps, min_samples


def neighbour_counts(points: DataFrame, coords: list[str], eps: float, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Neighbour count (self included) of every point whose cell is not full; full cells need none."""
    grid = _Grid(coords, eps)
    placed = grid.placed(points)
    cells = placed.groupBy(*grid.cell).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialise(placed.join(cells, grid.cell))
    return _sparse_matches(grid, counted, cells, min_samples).groupBy(F.col("p").alias("id")).agg(
        F.sum("neighbours").alias("neighbours")
    )


def assign_to_clusters(
    rows: DataFrame, core: DataFrame, coords: list[str], eps: float
) -> DataFrame:
    """Label of new rows: the smallest label with a core point within eps, else -1.

    ``core`` is ``(id, label, coords...)`` of the training core points.  All core
    points of a cell share a label, so a row asks each nearby cell only whether it
    has a core point within eps, with the halved boxes again.
    """
    grid = _Grid(coords, eps)
    core_cells = materialise(
        core.select("label", *coords, *[grid.index(i).alias(c) for i, c in enumerate(grid.cell)])
    )
    labels = core_cells.groupBy(*grid.cell).agg(F.min("label").alias("label"))
    placed = grid.placed(rows).select(
        F.col("id").alias("p"), *[F.col(c).alias(f"p_{c}") for c in coords], *[F.col(c).alias(f"p{c}") for c in grid.cell],
        grid.around().alias("_o"),
    )
    lookups = placed.withColumns({c: F.col(f"p{c}") + F.col(f"_o.o{i}") for i, c in enumerate(grid.cell)})
    open_rows = materialise(lookups.select("p", *[f"p_{c}" for c in coords], *grid.cell).join(labels, grid.cell))
    limit = F.lit(eps * eps)
    apart = _total(
        [
            F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"p_{c}"), F.col(f"p_{c}") - F.col(f"hi{i}")) ** 2
            for i, c in enumerate(coords)
        ]
    )
    reach = _total(
        [
            F.greatest(F.abs(F.col(f"hi{i}") - F.col(f"p_{c}")), F.abs(F.col(f"p_{c}") - F.col(f"lo{i}"))) ** 2
            for i, c in enumerate(coords)
        ]
    )
    found: list[DataFrame] = []
    level = 0
    while True:
        inside = core_cells.join(open_rows.select(*grid.cell).distinct(), grid.cell, "left_semi")
        boxes = _boxes(grid, inside, level, "").withColumnsRenamed({f"{c}": c for c in grid.cell})
        keys = list(grid.cell)
        if level > 0:
            for i in range(grid.d):
                boxes = boxes.withColumn(f"_p{i}", F.floor(F.col(f"s{i}") / 2).cast("bigint"))
            open_rows = open_rows.withColumnsRenamed({f"s{i}": f"_p{i}" for i in range(grid.d)})
            keys += [f"_p{i}" for i in range(grid.d)]
        kept = ["p", "label", *[f"p_{c}" for c in coords], *grid.cell, *[f"s{i}" for i in range(grid.d)]]
        judged = materialise(
            open_rows.join(boxes, keys).where(apart <= limit).select(*kept, (reach <= limit).alias("_near"))
        )
        near = judged.where("_near").select("p", *grid.cell, "label").distinct()
        found.append(near.select("p", "label"))
        open_rows = judged.where(~F.col("_near")).drop("_near").join(near, ["p", *grid.cell], "left_anti").select(*kept)
        if open_rows.isEmpty():
            break
        level += 1
    best = stack(found).groupBy(F.col("p").alias("id")).agg(F.min("label").alias("label"))
    return rows.select("id").join(best, "id", "left").select(
        "id", F.coalesce("label", noise_label(core, "label")).alias("label")
    )


def silhouette(labelled: DataFrame, column: str = "x") -> float | None:
    """Mean silhouette (squared distances) of the clustered points, None with fewer than two clusters.

    Labels must be numbers.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    clustered = labelled.where(F.col("label") != NOISE).select(
        array_to_vector(column).alias("features"), F.col("label").cast("double").alias("prediction")
    )
    if clustered.select("prediction").distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator().evaluate(clustered)
