"""Exact density clustering on any number of columns by a metric index.

Grids of cells do not reach beyond a few dimensions; distances to pivots do.  Every point
lives in the cell of its nearest pivot.  By the triangle inequality a point within ``eps``
of it is at most ``2 eps`` farther from that pivot than from its own nearest one, and its
distance to the pivot differs by ``eps`` at most.  So (pivot, distance in steps of ``eps``)
are join keys: a point meets only the candidates of its own ring and the two next to it,
in blocks of bounded size, which grow with a ring so that a point is copied a bounded number of times.  Points within ``eps / 2`` of one pivot are neighbours of each
other: where there are enough of them they are core points of one cluster and are never
compared among themselves, so that a dense group of any size stays linear.

How many pivots pay is estimated on a bounded sample: where all distances are alike, as
among random directions, no index prunes, and few pivots at least copy little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.shipping import by_value
from motorlens.operators.clusters import EPS, MIN_SAMPLES, RELAXED_EPS, RELAXED_SAMPLES, connected_components, noise_label
from motorlens.session import materialise

by_value(__name__)

# rows that pivots are chosen from, in expectation, and numbers of pivots that are weighed
SAMPLE_ROWS = 2000
PIVOTS = (1, 4, 16, 64)
# smallest block of points of either side that is worth a task of its own
BLOCK = 1024
# blocks a ring is cut into, so that a point is copied this often at most, until a block has as many points as one task holds
COPIES = 16
MOST_BYTES = 32 * 2**20
# rows of either side that are compared at once inside a task
TILE = 1024
# comparisons that cost as much as one more copy of a point
COPY_COST = 2000
# rings of a pivot; farther points share the last one
RINGS = 1000
# relative slack for rounding, so that no bound cuts off a neighbour
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def near_tiles(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs within eps, tile by tile; close calls are summed up difference by difference."""
    of_a, of_b = (a * a).sum(1), (b * b).sum(1)
    for top in range(0, len(a), TILE):
        x, own = a[top : top + TILE], of_a[top : top + TILE]
        for left in range(0, len(b), TILE):
            y, other = b[left : left + TILE], of_b[left : left + TILE]
            squares = x @ y.T
            squares *= -2
            squares += own[:, None]
            squares += other[None]
            slack = SLACK * (own.max() + other.max() + eps * eps)
            i, j = np.nonzero(squares <= eps * eps + slack)
            kept = squares[i, j] < eps * eps - slack
            for some in _pieces(np.flatnonzero(~kept), TILE * 16):
                kept[some] = ((x[i[some]] - y[j[some]]) ** 2).sum(1) <= eps * eps
            yield i[kept] + top, j[kept] + left


def _pieces(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (rows[at : at + size] for at in range(0, len(rows), size))


def _parts(rows: int, block: int, most: int) -> int:
    """Blocks of a ring: of ``block`` points while they are few, else as many as copies are allowed, of ``most`` points at most."""
    return max(-(-rows // most), min(-(-rows // block), COPIES))


def _rings(apart: np.ndarray, eps: float) -> np.ndarray:
    return np.minimum(np.floor(apart / eps), RINGS).astype(np.int64)


def _cost(apart: np.ndarray, eps: float, rows: int) -> float:
    """Estimated comparisons and copies of a point, in comparisons, from a sample's distances to pivots."""
    home = apart.argmin(1)
    rings = _rings(apart, eps)
    reached = apart - apart.min(1)[:, None] <= 2 * eps
    pairs = 0
    for i in range(apart.shape[1]):
        own = np.bincount(rings[home == i, i], minlength=RINGS + 3)
        others = np.bincount(rings[reached[:, i], i], minlength=RINGS + 3)
        pairs += int((own * (others + np.roll(others, 1) + np.roll(others, -1))).sum())
    return pairs / len(apart) ** 2 * rows + 3 * COPY_COST * reached.sum() / len(apart)


def choose_pivots(points: DataFrame, column: str, eps: float) -> np.ndarray:
    """Pivots from a hash-chosen sample: densest spots and points far from all others in turn, as many as pay."""
    rows = points.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sampled = points.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
    # SAMPLE_ROWS rows in expectation
    table = sampled.select("id", column).toArrow()
    if not table.num_rows:
        return np.zeros((1, 0))
    sample = _matrix(table.column(column))
    sample = sample[np.lexsort(sample.T[::-1])]
    apart = distances(sample, sample)
    crowd = (apart <= eps / 2).sum(1)
    chosen, nearest = [int(crowd.argmax())], apart[crowd.argmax()].copy()
    while len(chosen) < min(PIVOTS[-1], len(sample)):
        # a spot is only as dense as what no pivot holds yet
        open_ = nearest > eps / 2
        left = (apart[:, open_] <= eps / 2).sum(1) * open_
        best = int(left.argmax()) if len(chosen) % 2 == 0 and left.max() > 1 else int(nearest.argmax())
        if nearest[best] == 0:
            break
        chosen.append(best)
        nearest = np.minimum(nearest, apart[best])
    counts = [k for k in PIVOTS if k <= len(chosen)] or [len(chosen)]
    best = min(counts, key=lambda k: _cost(apart[:, chosen[:k]], eps, rows))
    return sample[chosen[:best]]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class _Cells:
    """Where points live and which cells they are candidates of."""

    def __init__(self, pivots: np.ndarray, eps: float) -> None:
        self.pivots, self.eps = pivots, eps

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = distances(x, self.pivots)
        home = apart.argmin(1)
        return apart, home, _rings(apart[np.arange(len(x)), home], self.eps)

    def candidates(self, apart: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """``(rows, cell, ring)``: the rings of other points' homes in which a point may have neighbours."""
        slack = SLACK * (1 + apart.max(initial=0))
        for cell in range(len(self.pivots)):
            rows = np.flatnonzero(apart[:, cell] - apart.min(1) <= 2 * self.eps + slack)
            low = _rings(np.maximum(apart[rows, cell] - self.eps - slack, 0), self.eps)
            high = _rings(apart[rows, cell] + self.eps + slack, self.eps)
            for step in range(3):
                inside = low + step <= high
                yield rows[inside], cell, (low + step)[inside]


def _count_kernel(cells: _Cells) -> Callable:
    """Points ``(x, asks, answers)`` to how many homes and candidates of each kind a ring has."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            x, asks, answers = _matrix(batch.column(0)), *(batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
            apart, home, ring = cells.homes(x)
            for c, r in zip(home[asks], ring[asks]):
                counts.setdefault((int(c), int(r)), [0, 0])[0] += 1
            for rows, cell, rings in cells.candidates(apart):
                for r, n in zip(*np.unique(rings[answers[rows]], return_counts=True)):
                    counts.setdefault((cell, int(r)), [0, 0])[1] += int(n)
        yield pa.RecordBatch.from_pylist(
            [{"cell": c, "ring": r, "homes": a, "others": b} for (c, r), (a, b) in counts.items()],
            schema=pa.schema([("cell", pa.int32()), ("ring", pa.int64()), ("homes", pa.int64()), ("others", pa.int64())]))

    return kernel


def _deal_kernel(cells: _Cells, blocks: dict[tuple[int, int], tuple[int, int]]) -> Callable:
    """Points ``(id, x, node, group, asks, answers, spread)`` to the blocks of their rings in which they ask or answer."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            x = _matrix(batch.column(names.index("x")))
            asks, answers = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "answers"))
            spread = batch.column(names.index("spread")).to_numpy().view(np.uint64)
            apart, home, ring = cells.homes(x)

            def dealt(rows: np.ndarray, cell: np.ndarray, ring: np.ndarray, side: int) -> Iterator[pa.RecordBatch]:
                at, keys = [], []
                for row, c, r in zip(rows, cell, ring):
                    a, b = blocks.get((int(c), int(r)), (0, 0))
                    if a and b:
                        own, across = (a, b) if side == 0 else (b, a)
                        mine = int(spread[row] % np.uint64(own))
                        for other in range(across):
                            at.append(row)
                            keys.append((c, r, mine, other) if side == 0 else (c, r, other, mine))
                            if len(at) >= 20_000:
                                yield table(at, keys, side)
                                at, keys = [], []
                if at:
                    yield table(at, keys, side)

            def table(at: list, keys: list, side: int) -> pa.RecordBatch:
                columns = np.array(keys, np.int64).T
                taken = batch.take(pa.array(np.array(at, np.int64)))
                return pa.RecordBatch.from_arrays(
                    [*(pa.array(c) for c in columns), pa.array(np.full(len(at), side, np.int32)),
                     *(taken.column(names.index(c)) for c in ("id", "node", "group", "x"))],
                    names=["cell", "ring", "mine", "other", "side", "id", "node", "group", "x"])

            who = np.flatnonzero(asks)
            yield from dealt(who, home[who], ring[who], 0)
            for rows, cell, rings in cells.candidates(apart):
                some = answers[rows]
                yield from dealt(rows[some], np.full(int(some.sum()), cell), rings[some], 1)

    return kernel


def _met(points: DataFrame, pivots: np.ndarray, eps: float, block: int, compare: Callable, into: str) -> DataFrame:
    """Every asking point beside all answering ones within reach, block by block.

    ``points`` has ``id, x, node, group, asks, answers``; ``compare`` gets the asking and
    the answering rows of a block and, tile by tile, which of them are within eps.
    """
    cells = _Cells(pivots, eps)
    counted = points.select("x", "asks", "answers").mapInArrow(_count_kernel(cells), "cell int, ring long, homes long, others long")
    # a row per ring and pivot, RINGS and PIVOTS at most
    sizes = counted.groupBy("cell", "ring").agg(F.sum("homes").alias("homes"), F.sum("others").alias("others")).collect()
    most = max(block, MOST_BYTES // (8 * max(pivots.shape[1], 1)))
    blocks = {(r["cell"], r["ring"]): (_parts(r["homes"], block, most), _parts(r["others"], block, most)) for r in sizes}
    kinds = {f.name: f.dataType for f in points.schema.fields}
    longs = [T.StructField(c, T.LongType()) for c in ("cell", "ring", "mine", "other")]
    schema = T.StructType([*longs, T.StructField("side", T.IntegerType()), *(T.StructField(c, kinds[c]) for c in ("id", "node", "group", "x"))])
    spread = points.withColumn("spread", F.xxhash64("id", F.lit(3)))
    dealt = spread.select("id", "x", "node", "group", "asks", "answers", "spread").mapInArrow(_deal_kernel(cells, blocks), schema)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not left.num_rows or not right.num_rows:
            return compare(left.slice(0, 0), right.slice(0, 0), iter(()))
        return compare(left, right, near_tiles(_matrix(left.column("x")), _matrix(right.column("x")), eps))

    return dealt.groupBy("cell", "ring", "mine", "other").applyInArrow(run, into)


def _counted(left: pa.Table, right: pa.Table, tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    n = np.zeros(left.num_rows, np.int64)
    for i, _ in tiles:
        n += np.bincount(i, minlength=len(n))
    return pa.table({"id": left.column("id"), "n": pa.array(n), "compared": pa.array(np.full(left.num_rows, right.num_rows, np.int64))})


def _join(part_of: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the parts of the points ``u`` and ``v``, in place; a part is named by its smallest point."""
    while True:
        a, b = part_of[u], part_of[v]
        apart = a != b
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(part_of, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (part_of[part_of] != part_of).any():
            part_of[:] = part_of[part_of]


def _linked(left: pa.Table, right: pa.Table, tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Links ``(u, v)`` that join what hangs together in a block, and ``(id, v)`` from border points to each such part.

    A part of n points gives fewer than n links, however many of its points are neighbours.
    """
    n = right.num_rows
    core = left.column("group").to_numpy(zero_copy_only=False) >= CORE if left.num_rows else np.zeros(0, bool)
    # a border point needs one of the points that bear a name
    code = right.column("node").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    bearer = np.unique(code, return_index=True)[1]
    part_of, first_of, border = np.arange(n), np.full(left.num_rows, -1), [np.zeros(0, np.int64)]
    for i, j in tiles:
        own = core[i]
        who, to = i[own], j[own]
        rows, at = np.unique(who, return_index=True)
        new = first_of[rows] < 0
        first_of[rows[new]] = to[at[new]]
        _join(part_of, to, first_of[who])
        border.append(np.unique(i[~own] * n + bearer[code[j[~own]]]))
    rows = np.flatnonzero(first_of >= 0)
    first = part_of[first_of[rows]]
    moved = np.flatnonzero(part_of != np.arange(n))
    found = np.unique(np.concatenate(border))
    who, part = (found // n, part_of[found % n]) if len(found) else (found, found)
    ids, nodes, others = left.column("id"), left.column("node"), right.column("node")
    none = lambda k, of: pa.nulls(k, of.type)
    return pa.table({
        "id": pa.chunked_array([none(len(rows) + len(moved), ids), *ids.take(pa.array(who)).chunks], ids.type),
        "u": pa.chunked_array([*nodes.take(pa.array(rows)).chunks, *others.take(pa.array(moved)).chunks, none(len(who), nodes)], nodes.type),
        "v": pa.chunked_array([*others.take(pa.array(np.concatenate([first, part_of[moved], part]))).chunks], others.type),
    })


# what a point is: the number of its dense group, or one of these
CORE, NOT_CORE = -1, -2


def _placed(points: DataFrame, column: str, pivots: np.ndarray, eps: float) -> DataFrame:
    """``(id, x, inner)``: the pivot within ``eps / 2`` of which a point lies, else -1."""
    cells = _Cells(pivots, eps)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, home, _ = cells.homes(_matrix(batch.column(1)))
            nearest = apart.min(1)
            inner = np.where(nearest <= eps / 2 - SLACK * (1 + nearest), home, CORE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner.astype(np.int32))], names=["id", "x", "inner"])

    kind = points.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("inner", T.IntegerType())])
    return materialise(points.select("id", F.col(column).cast("array<double>").alias("x")).mapInArrow(kernel, schema))


def _complete(points: DataFrame, column: str) -> DataFrame:
    values = F.col(column)
    return points.where(values.isNotNull() & ~F.exists(values, lambda v: v.isNull() | F.isnan(v.cast("double"))))


def neighbour_counts(points: DataFrame, column: str, eps: float, block: int = BLOCK) -> DataFrame:
    """``(id, neighbours, compared)`` of every point: points within eps, itself included, and points it was compared with."""
    whole = _complete(points, column)
    pivots = choose_pivots(whole, column, eps)
    rows = whole.select(
        "id", F.col(column).cast("array<double>").alias("x"), F.col("id").alias("node"), F.lit(CORE).alias("group"),
        F.lit(True).alias("asks"), F.lit(True).alias("answers"))
    kind = points.schema["id"].dataType.simpleString()
    met = _met(rows, pivots, eps, block, _counted, f"id {kind}, n long, compared long")
    return met.groupBy("id").agg(F.sum("n").alias("neighbours"), F.sum("compared").alias("compared"))


def dbscan(points: DataFrame, column: str, eps: float = EPS, min_samples: int = MIN_SAMPLES, block: int = BLOCK) -> DataFrame:
    """``(id, label, is_core)`` from a unique ``id`` and a column of coordinates of any number, all rows of one length.

    The label is the smallest core id of the cluster, -1 is noise; a border point within
    reach of several clusters takes the smallest label.  A point with a missing
    coordinate is noise.  Labels have the type of the id.
    """
    whole = _complete(points, column)
    pivots = choose_pivots(whole, column, eps)
    placed = _placed(whole, column, pivots, eps)
    kind = points.schema["id"].dataType
    # a row per pivot at most
    dense = {
        r["inner"]: r["first"] for r in placed.where(F.col("inner") >= 0).groupBy("inner").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_samples).collect()}

    def by_group(of: dict, otherwise):
        return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("inner")], otherwise) if of else otherwise

    group = by_group({i: i for i in dense}, F.lit(CORE))
    grouped = placed.select("id", "x", by_group(dense, F.col("id")).cast(kind).alias("node"), group.cast("int").alias("group"))
    asked = grouped.withColumns({"asks": F.col("group") == CORE, "answers": F.lit(True)})
    counts = _met(asked, pivots, eps, block, _counted, f"id {kind.simpleString()}, n long, compared long").groupBy("id").agg(F.sum("n").alias("n"))
    sparse = counts.where(F.col("n") < min_samples).select("id", F.lit(NOT_CORE).alias("_none"))
    known = materialise(grouped.join(sparse, "id", "left").withColumn("group", F.coalesce("_none", "group")).drop("_none"))

    # two dense groups are linked where their pivots, which are points of them, are neighbours; those farther than 2 eps are not
    apart = distances(pivots, pivots)
    pairs = [(i, j) for i in dense for j in dense if i < j]
    linked = [(dense[i], dense[j]) for i, j in pairs if apart[i, j] <= eps * (1 - SLACK)]
    doubtful = {i for pair in pairs if eps * (1 - SLACK) < apart[pair] <= 2 * eps * (1 + SLACK) for i in pair}
    asks = F.col("group") < 0 if not doubtful else (F.col("group") < 0) | F.col("group").isin(*doubtful)
    met = materialise(_met(
        known.withColumns({"asks": asks, "answers": F.col("group") >= CORE}), pivots, eps, block, _linked,
        T.StructType([T.StructField(c, kind) for c in ("id", "u", "v")])))
    edges = met.where(F.col("u").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    spark = points.sparkSession
    direct = spark.createDataFrame(linked, T.StructType([T.StructField(c, kind) for c in "uv"]))
    component = materialise(connected_components(edges.unionByName(direct)))
    # the label of a dense group, which may hold many points, is looked up once
    names = {r["node"]: r["component"] for r in component.where(F.col("node").isin(*dense.values())).collect()} if dense else {}
    of_dense = {i: names.get(first, first) for i, first in dense.items()}
    in_group = F.create_map(*[F.lit(x) for kv in of_dense.items() for x in kv])[F.col("group")] if of_dense else F.lit(None)
    core = known.where(F.col("group") >= CORE)
    label = F.coalesce("component", "node")
    alone = core.where(F.col("group") == CORE).select("id", F.col("id").alias("node")).join(component, "node", "left")
    cores = alone.select("id", label.alias("label")).unionByName(
        core.where(F.col("group") >= 0).select("id", in_group.cast(kind).alias("label"))).withColumn("is_core", F.lit(True))
    border = met.where(F.col("id").isNotNull()).select("id", F.col("v").alias("node")).distinct().join(component, "node", "left")
    borders = border.select("id", label.alias("label")).groupBy("id").agg(F.min("label").alias("label")).withColumn("is_core", F.lit(False))
    return points.select("id").join(cores.unionByName(borders), "id", "left").select(
        "id", F.coalesce("label", noise_label(points, "id")).alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def dbscan_relaxed(points: DataFrame, column: str, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> tuple[DataFrame, float, int]:
    """Clusters, and where there are none once more with a wider eps and fewer points; also the values used."""
    labels = materialise(dbscan(points, column, eps, min_samples))
    if not labels.where("is_core").isEmpty():
        return labels, eps, min_samples
    eps, min_samples = eps * RELAXED_EPS, max(2, int(min_samples * RELAXED_SAMPLES))
    return materialise(dbscan(points, column, eps, min_samples)), eps, min_samples


def assign_to_clusters(rows: DataFrame, core: DataFrame, column: str, eps: float, block: int = BLOCK) -> DataFrame:
    """``(id, label)`` of new rows: the smallest label with a core point ``(id, label, column)`` within eps, else -1."""
    kind, label = rows.schema["id"].dataType, core.schema["label"].dataType
    x = F.col(column).cast("array<double>").alias("x")
    asking = _complete(rows, column).select(
        F.col("id").cast("string").alias("id"), x, F.lit(None).cast(label).alias("node"), F.lit(NOT_CORE).alias("group"),
        F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    answering = core.select(
        F.col("id").cast("string").alias("id"), x, F.col("label").alias("node"), F.lit(CORE).alias("group"),
        F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    both = materialise(asking.unionByName(answering))
    pivots = choose_pivots(both, "x", eps)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("u", label), T.StructField("v", label)])
    met = _met(both, pivots, eps, block, _linked, schema)
    best = met.where(F.col("id").isNotNull()).groupBy(F.col("id").cast(kind).alias("id")).agg(F.min("v").alias("label"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("label", noise_label(core, "label")).alias("label"))
