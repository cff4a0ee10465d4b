"""Density clusters on many columns against all pairs."""

import numpy as np
import pytest

from motorlens.operators import metric as N


def clusters(x, eps, samples):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= samples
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    return {(i, int(v), bool(c)) for i, (v, c) in enumerate(zip(label, core))}


def planted(n, d, seed=0):
    """Blobs of several sizes, a dense group, exact copies, a chain, a lattice whose distances are ties, and noise."""
    r = np.random.default_rng(seed)
    blobs = [r.normal(0, 0.35, (n // 4, d)) / np.sqrt(d) + 4 * r.normal(size=d) for _ in range(2)]
    chain = np.outer(np.arange(n // 10) * 0.45, np.eye(d)[0]) + 30
    lattice = np.array([[i * 0.5, j * 0.5] + [9.0] * (d - 2) for i in range(6) for j in range(6)])
    return np.concatenate([*blobs, np.full((n // 8, d), 7.0), r.normal(0, 0.01, (n // 4, d)) - 5, chain, lattice, r.uniform(-40, 40, (n // 10, d))])


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, x array<double>")


@pytest.mark.parametrize("d, eps, samples, block", [(2, 0.5, 4, 16), (8, 0.5, 4, 1024), (24, 0.6, 3, 40), (24, 0.01, 2, 1024), (5, 100.0, 3, 64)])
def test_clusters_equal_all_pairs(spark, d, eps, samples, block):
    x = planted(240, d)
    points = frame(spark, x)
    found = N.dbscan(points, "x", eps, samples, block).collect()
    assert {tuple(r) for r in found} == clusters(x, eps, samples) and len(found) == len(x)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    counts = {r["id"]: r["neighbours"] for r in N.neighbour_counts(points, "x", eps, block).collect()}
    assert counts == dict(enumerate(near.sum(1).tolist()))


def test_new_rows_meet_core_points(spark):
    x = planted(200, 6)
    labels = clusters(x, 0.5, 4)
    rows = frame(spark, np.concatenate([x + 0.05, x[:5] + 500]))
    core = frame(spark, x).join(spark.createDataFrame([v[:2] for v in labels if v[2]], "id bigint, label bigint"), "id")
    of = {i: v for i, v, c in labels if c}
    new = np.concatenate([x + 0.05, x[:5] + 500])
    near = ((new[:, None] - x[None]) ** 2).sum(-1) <= 0.25
    expected = {i: min((of[j] for j in np.flatnonzero(near[i]) if j in of), default=-1) for i in range(len(new))}
    assert {r["id"]: r["label"] for r in N.assign_to_clusters(rows, core, "x", 0.5).collect()} == expected


def test_rows_without_coordinates_and_empty_frames(spark):
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0, 2.1]), ("e", [float("nan"), 0.0])]
    points = spark.createDataFrame(rows, "id string, x array<double>")
    found = {r["id"]: (r["label"], r["is_core"]) for r in N.dbscan(points, "x", 0.5, 2).collect()}
    assert found == {"a": ("a", True), "d": ("a", True), "b": ("-1", False), "c": ("-1", False), "e": ("-1", False)}
    assert N.dbscan(points.limit(0), "x", 0.5, 2).count() == 0


def test_compared_pairs_of_growing_inputs(spark):
    """A dense group is not compared with itself, and far blobs do not meet."""
    compared = []
    for n in (400, 1600):
        r = np.random.default_rng(1)
        x = np.concatenate([r.normal(0, 0.2, (10, 12)) / 3.5 + r.uniform(-60, 60, 12) for _ in range(n // 10)])
        compared.append(N.neighbour_counts(frame(spark, x), "x", 0.5).agg({"compared": "sum"}).first()[0] / n**2)
    assert compared[0] < 0.2 and compared[1] < 0.1


def test_a_dense_group_of_a_third_of_all_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.005, (400, 10)), r.uniform(-20, 20, (800, 10))])
    blocks = []
    met = N._met

    def watched(points, pivots, eps, block, compare, into):
        blocks.append(points.where("asks").count())
        return met(points, pivots, eps, block, compare, into)

    monkeypatch.setattr(N, "_met", watched)
    found = {tuple(r) for r in N.dbscan(frame(spark, x), "x", 0.5, 5).collect()}
    assert found == clusters(x, 0.5, 5) and max(blocks) <= 800


def test_copies_of_a_point_are_bounded(spark):
    """Where nothing can be pruned, larger blocks meet instead of more copies."""
    x = np.random.default_rng(3).normal(size=(700, 6))
    rows = frame(spark, x).selectExpr("id", "x", "id AS node", f"{N.CORE} AS `group`", "true AS asks", "true AS answers")
    met = N._met(rows, x[:1], 50.0, 16, N._counted, "id bigint, n long, compared long").groupBy("id").agg({"*": "count", "n": "sum"}).collect()
    assert max(r["count(1)"] for r in met) == N.COPIES < 700 // 16 and {r["sum(n)"] for r in met} == {700}


def test_a_block_of_many_tiles(monkeypatch):
    monkeypatch.setattr(N, "TILE", 7)
    x = planted(160, 3)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.25
    found = [set(zip(i.tolist(), j.tolist())) for i, j in N.near_tiles(x, x, 0.5)]
    assert set().union(*found) == set(zip(*(c.tolist() for c in np.nonzero(near)))) and sum(map(len, found)) == near.sum()
