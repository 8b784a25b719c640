"""Vector, plane and polygon expressions against numpy and hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoplane.functions import vectors as V
from stratoplane.functions.planefit import plane_fit
from stratoplane.operators import polygons, ransac
from stratoplane.operators.growth import seeded_growing
from stratoplane.operators.patches import greedy_merge, growth_levels


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def lit(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_conventions(spark):
    n = lit(0, 0, 1)
    r = one(spark, level=V.dip(n), wall=V.dip(lit(1, 0, 0)), east=V.dip_direction(lit(0.5, 0, 0.5)), north=V.dip_direction(lit(0, 0.5, 0.5)), west=V.dip_direction(lit(-0.5, 0, 0.5)), fold=V.plane_angle(n, lit(0, 0, -1)))
    assert r == {"level": 0.0, "wall": 90.0, "east": 90.0, "north": 0.0, "west": 270.0, "fold": 0.0}
    back = one(spark, **{c: v for c, v in zip("xyz", V.normal_of(F.lit(30.0), F.lit(90.0)))})
    assert [back[c] for c in "xyz"] == pytest.approx([0.5, 0, np.sqrt(0.75)])
    flat = one(spark, area=V.triangle_area(lit(0, 0, 0), lit(3, 0, 0), lit(0, 4, 0)), volume=V.tetrahedron_volume(lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0), lit(0, 0, 1)), angle=V.vertex_angle(lit(1, 0, 0), lit(0, 0, 0), lit(0, 1, 0)), none=V.plane_through(lit(0, 0, 0), lit(1, 1, 1), lit(2, 2, 2))[0][0])
    assert flat["area"] == 6 and flat["volume"] == pytest.approx(1 / 6) and flat["angle"] == pytest.approx(90) and flat["none"] is None


@pytest.mark.parametrize("seed", range(4))
def test_plane_fit_against_numpy(spark, seed):
    draw = np.random.default_rng(seed)
    xyz = draw.normal(size=(200, 3)) * [3, 2, 0.1] @ np.linalg.qr(draw.normal(size=(3, 3)))[0] + [5e5, -3e6, 100]
    f = plane_fit(spark.createDataFrame([(1, *map(float, p)) for p in xyz], "k int, x double, y double, z double"), ["k"]).first()
    values, vectors = np.linalg.eigh(np.cov(xyz.T, bias=True))
    n = np.array([f["a"], f["b"], f["c"]])
    assert abs(n @ vectors[:, 0]) == pytest.approx(1, abs=1e-9) and n[2] >= 0
    assert [f["l0"], f["l1"], f["l2"]] == pytest.approx(values, rel=1e-6) and f["rmse"] == pytest.approx(np.sqrt(values[0]), rel=1e-6)


def test_degenerate_fits(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0), (2, 2.0, 2.0, 2.0), (3, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0), (4, 0.0, 0.0, 5.0), (4, 1.0, 0.0, 5.0), (4, 0.0, 1.0, 5.0)]
    f = {r["k"]: r for r in plane_fit(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).collect()}
    assert f[1]["a"] is None and f[2]["a"] is None and f[3]["a"] is None
    assert (f[4]["c"], f[4]["d"], f[4]["rmse"]) == (pytest.approx(1), pytest.approx(-5), pytest.approx(0, abs=1e-7))


def test_square(spark):
    corners = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "id int, k long, u double, v double")
    assert polygons.areas(corners, "id").first()["area"] == 1 and polygons.diameters(corners, "id").first()["trace"] == pytest.approx(np.sqrt(2))
    width = polygons.widths(corners, "id", spark.createDataFrame([(1, 3)], "id int, lines int")).orderBy("line").collect()
    assert [w["width"] for w in width] == pytest.approx([np.sqrt(2) / 2, np.sqrt(2), np.sqrt(2) / 2])
    assert [(r["v0"], r["v1"], r["v2"]) for r in polygons.triangle_fan(corners, "id").orderBy("k").collect()] == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1)]


def test_hull(spark):
    draw = np.random.default_rng(1)
    uv = draw.uniform(-1, 1, (500, 2))
    corners = polygons.hull_numpy(uv)
    n = np.roll(uv[corners], -1, axis=0) - uv[corners]
    for p in uv:
        off = p - uv[corners]
        assert (n[:, 0] * off[:, 1] - n[:, 1] * off[:, 0] >= -1e-12).all()


def test_ransac_and_growing_find_planes(spark):
    draw = np.random.default_rng(3)
    a = np.column_stack([draw.uniform(-5, 5, (400, 2)), draw.normal(0, 0.01, 400)])
    b = np.column_stack([draw.uniform(-5, 5, 300), np.full(300, 0.0) + draw.normal(0, 0.01, 300), draw.uniform(3, 12, 300)])
    rows = [(int(i), *map(float, p)) for i, p in enumerate(np.vstack([a, b]))]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    planes, members = ransac.detect_planes(points, 0.05, 100, 60)
    found = planes.orderBy("plane_id").collect()
    assert len(found) == 2 and abs(found[0]["c"]) > 0.999 and abs(found[1]["b"]) > 0.999
    assert members.select("point_id").distinct().count() == members.count() >= 690
    normals = np.vstack([np.tile([0, 0, 1.0], (400, 1)), np.tile([0, 1.0, 0], (300, 1))])
    region = seeded_growing(np.vstack([a, b]), normals, 0.4, 20, 50)
    assert set(region[:400]) - {-1} != set(region[400:]) - {-1} and (region >= 0).mean() > 0.9


def test_growth_levels_and_merge():
    levels = growth_levels(0.3, 30, 0.1, 10)
    assert [x[0] for x in levels] == [0, 1, 2, 3] and levels[0][1:] == (0.3, 30) and levels[-1][1:] == pytest.approx((0, 0))
    flat = np.diag([1.0, 1.0, 0.0])
    rows = [{"patch": k, "error": 0.1 * k, "n": 10, "c": (1.5 * k, 0, 0), "m": flat} for k in range(3)] + [{"patch": 9, "error": 0.0, "n": 10, "c": (0, 0, 2), "m": flat}]
    assert greedy_merge(rows, [(0, 1), (1, 2), (0, 9)], 10, 0.5, 1.0) == {9: 9, 0: 0, 1: 0, 2: 0}


def test_ransac_query_finds_every_plane(spark, monkeypatch):
    """Six planes, two more than the query once stopped at, and fewer stray points than a plane needs."""
    from stratoplane.plans import plot_queries

    draw = np.random.default_rng(8)
    xyz = np.vstack([np.column_stack([draw.uniform(-5, 5, (130, 2)), np.full(130, 10.0 * k)]) for k in range(6)] + [draw.uniform(100, 200, (20, 3))])
    points = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double").coalesce(1)
    monkeypatch.setattr(plot_queries, "pts", lambda spark, sf: points)
    found = plot_queries.sequential_ransac(spark, "").collect()
    assert sorted((r["n"], round(-r["d"])) for r in found) == [(130, 10 * k) for k in range(6)] and sorted(r["plane_id"] for r in found) == list(range(6))


def test_pipeline_keeps_what_the_first_plane_leaves(spark, monkeypatch):
    """Two parallel planes in one voxel, whose mean plane is near no point, and too few points for a seed of one of them, with stray ones, in the next voxel."""
    from stratoplane.plans import plot_queries

    draw = np.random.default_rng(6)
    flat = lambda n, x, z: np.column_stack([draw.uniform(x, x + 1.9, n), draw.uniform(0, 1.9, n), np.full(n, z)])
    xyz = np.vstack([[[0, 0, 0.4]], flat(69, 0, 0.4), flat(60, 0, 1.6), flat(28, 2.05, 0.4), [[0, 0, 0], [2.2, 0.3, 1.9], [3.1, 1.1, 1.0], [2.6, 1.7, 1.3], [3.5, 0.2, 1.2], [2.9, 0.8, 0.9]]])
    points = spark.createDataFrame([(int(i), *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double, nx double, ny double, nz double").coalesce(1)
    monkeypatch.setattr(plot_queries, "with_normals", lambda spark, sf: points)
    got = {r["point_id"]: (r["seed"], r["disc"]) for r in plot_queries.voxel_patch_pipeline(spark, "").collect()}
    assert set(got) == set(range(158)) and {got[i] for i in (*range(70), *range(130, 158))} == {(0, 0)}
    assert len({got[i] for i in range(70, 130)}) == 1 and got[70][0] == got[70][1] == 10**13
