"""Order-free growth, density clusters, spanning trees and neighbour joins against brute force and known scenes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoplane.operators import growth, neighbours, patches, voxels
from stratoplane.operators.graph import components
from stratoplane.operators.statistics import wasserstein_ranked


def frame(spark, xyz, normals=None):
    rows = [(int(i), *map(float, p), *(map(float, normals[i]) if normals is not None else ())) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double" + (", nx double, ny double, nz double" if normals is not None else ""))


@pytest.fixture(scope="module")
def cloud():
    draw = np.random.default_rng(7)
    return np.vstack([draw.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 9, 4))] + [draw.uniform(-20, 20, (15, 3))])


def test_radius_and_nearest(spark, cloud):
    df = frame(spark, cloud)
    d2 = ((cloud[:, None] - cloud[None]) ** 2).sum(axis=2)
    got = {(r["a_id"], r["b_id"]) for r in neighbours.radius_join(df, df, 0.5).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d2 <= 0.25))}
    near = neighbours.knn_join(df, df, 4).collect()
    want = {(i, int(j), n + 1) for i in range(len(cloud)) for n, j in enumerate(np.lexsort((np.arange(len(cloud)), d2[i]))[:4])}
    assert {(r["a_id"], r["b_id"], r["rank"]) for r in near} == want


def test_dbscan(spark, cloud):
    got = {r["point_id"]: r["label"] for r in growth.dbscan(frame(spark, cloud), 0.6, 5).collect()}
    near = ((cloud[:, None] - cloud[None]) ** 2).sum(axis=2) <= 0.36
    core = near.sum(axis=1) >= 5
    label, k = np.full(len(cloud), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = k
                        todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    assert [got[i] for i in range(len(cloud))] == label.tolist()


def test_region_growing_splits_a_book(spark):
    g = np.arange(0, 1, 0.1)
    flat = np.array([(x, y, 0) for x, y in itertools.product(g, g)])
    wall = np.array([(-0.02, y, z + 0.12) for y, z in itertools.product(g, g)])
    normals = np.vstack([np.tile([0, 0, 1.0], (100, 1)), np.tile([1.0, 0, 0], (100, 1))])
    got = growth.region_growing(frame(spark, np.vstack([flat, wall]), normals), 0.08, 20, 20).collect()
    assert {r["region"] for r in got if r["point_id"] < 100} == {0} and {r["region"] for r in got if r["point_id"] >= 100} == {100}


def test_spanning_tree(spark):
    draw = np.random.default_rng(5)
    edges = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(draw.integers(0, 40, 160), draw.integers(0, 40, 160), draw.integers(1, 30, 160)) if a != b}
    tree = growth.spanning_tree(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")).collect()
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = 0.0
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want += w
    assert sum(r["w"] for r in tree) == want


def test_normals_agree_along_the_tree(spark):
    draw = np.random.default_rng(9)
    xy = draw.uniform(0, 4, (80, 2))
    z = 0.3 * np.sin(xy[:, 0])
    normals = np.column_stack([-0.3 * np.cos(xy[:, 0]), np.zeros(80), np.ones(80)])
    normals *= draw.choice([-1.0, 1.0], 80)[:, None] / np.linalg.norm(normals, axis=1)[:, None]
    got = growth.oriented_normals(frame(spark, np.column_stack([xy, z]), normals), 5, 1.0).collect()
    assert len(got) == 80 and all(r["nz"] > 0 for r in got)


def test_voxels_are_a_partition(spark, cloud):
    keyed = voxels.with_voxels(frame(spark, cloud), 1.0)
    assert keyed.count() == len(cloud) and voxels.occupancy(keyed).agg(F.sum("num_points")).first()[0] == len(cloud)
    assert keyed.agg(F.min("vx"), F.min("vy"), F.min("vz")).first() == (0, 0, 0)
    report = voxels.tiles(frame(spark, cloud), 4.0, 0.1)
    assert report.select("point_id").distinct().count() == len(cloud)


def test_cell_components(spark):
    cells = [(1, i, j) for i, j in ((0, 0), (0, 1), (1, 1), (5, 5), (6, 6), (9, 0))] + [(2, 0, 0)]
    df = spark.createDataFrame(cells, "k int, ci long, cj long")
    sizes = lambda eight: sorted(r["count"] for r in patches.cell_components(df, ["k"], eight).groupBy("k", "component").count().collect())
    assert sizes(True) == [1, 1, 2, 3] and sizes(False) == [1, 1, 1, 1, 3]
    best = patches.largest_component(patches.cell_components(df, ["k"]), ["k"]).where("k = 1").collect()
    assert {(r["ci"], r["cj"]) for r in best} == {(0, 0), (0, 1), (1, 1)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_shape_distributions_are_shares(spark, cloud):
    got = growth.shape_distributions(frame(spark, cloud[:60]), 0.8, 32, 8).collect()
    assert len(got) == 300 and all(abs(sum(r["histogram"]) - 1) < 1e-9 for r in got)


def test_curvature_search_goes_on_until_it_is_still(spark):
    """A large even cluster and a small rough one that loses its rougher points: an average over all points hardly moves."""
    draw = np.random.default_rng(4)
    flat = np.column_stack([draw.uniform(0, 2, (900, 2)), np.zeros(900)])
    rough = np.column_stack([draw.uniform(0, 1, (120, 2)), np.full(120, 9.0)])
    tilt = np.vstack([np.zeros((900, 2)), draw.normal(0, 0.4, (120, 2)) * np.repeat([[0.1], [1.0]], 60, axis=0)])
    normals = np.column_stack([tilt, np.ones(1020)])
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    curvature = np.r_[np.full(960, 0.001), np.full(60, 0.085)]
    points = frame(spark, np.vstack([flat, rough]), normals).join(spark.createDataFrame([(i, float(c)) for i, c in enumerate(curvature)], "point_id long, curvature double"), "point_id")
    rows = sorted(growth.curvature_search(points, 0.1, 0.02, 0.6, 4, patience=2, smallest=40).collect())
    assert [(r["clusters"], r["used"]) for r in rows] == [(2, 2)] * 4
    assert rows[0]["difference"] is None and rows[1]["difference"] > 500 and max(r["difference"] for r in rows[2:]) < 1e-6


def test_wasserstein_of_samples_of_different_size(spark):
    a, b = [5.0, 1.0, 4.0, 9.0, 2.5], [3.0, 8.0, 0.5]
    of = lambda v: spark.createDataFrame([(x,) for x in v], "v double")
    want = lambda x, y: np.abs(np.quantile(x, np.linspace(0, 1, max(len(x), len(y)))) - np.quantile(y, np.linspace(0, 1, max(len(x), len(y))))).mean()
    for x, y in ((a, b), (b, a), (a, [2.0]), ([2.0], [7.0])):
        assert abs(wasserstein_ranked(of(x), of(y), "v").first()[0] - want(x, y)) < 1e-9
