"""File round trips, faces of boxes, growth over leaves, voxel names and report helpers against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoplane.operators import growth, neighbours, polygons, statistics, voxels
from stratoplane.shared_store import release, shared_folder, written
from stratoplane.sources import converters, pointfiles, sinks


def test_csv_header_comes_first_and_text_is_quoted(spark, tmp_path):
    rows = [(k, 'a "word", and more' if k % 2 else None, k / 4) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, t string, v double").repartition(5)
    at = str(tmp_path / "out.csv")
    for _ in range(2):  # again: what was there is replaced
        sinks.write_csv(df, at, "K,T,V", ["k"])
    parts = sorted((tmp_path / "out.csv").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "K,T,V" and lines[1] == "0,,0.0" and lines[2] == '1,"a ""word"", and more",0.25' and len(lines) == 301
    assert [int(x.split(",")[0]) for x in lines[1:]] == list(range(300))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = pointfiles.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5003 and all(r["value"] == f"{r['file'].rsplit('/', 1)[-1]} {r['line_no']}" for r in got)


def test_group_files(spark, tmp_path):
    p = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") / 2).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("id") % 256).cast("int").alias("red"))
    names = {r["file_name"]: r["num_points"] for r in sinks.write_group_files(p, "g", "id", str(tmp_path / "f"), "g_%02d.ply", ["x", "y", "z", "red"], "binary").collect()}
    assert names == {"g_00.ply": 14, "g_01.ply": 13, "g_02.ply": 13}
    back = pointfiles.read_points(spark, str(tmp_path / "f" / "g_01.ply")).orderBy("point_id").collect()
    assert [(r["x"], r["red"]) for r in back] == [(k / 2, k) for k in range(1, 40, 3)]
    with pytest.raises(ValueError, match="facet_id"):
        pointfiles.by_alias(p, {"facet_id": ["scalar_facet_id"]})


def test_faces_of_boxes_of_many_sizes(spark):
    draw = np.random.default_rng(2)
    boxes = [(i, *(int(v) for lo, n in zip(draw.integers(0, 12, 3), draw.integers(0, 4, 3)) for v in (lo, lo + n))) for i in range(80)]
    want = set()
    for a in boxes:
        for b in boxes:
            for k, axis in enumerate("xyz"):
                over = all(a[1 + 2 * o] <= b[2 + 2 * o] and b[1 + 2 * o] <= a[2 + 2 * o] for o in range(3) if o != k)
                if a[2 + 2 * k] + 1 == b[1 + 2 * k] and over:
                    want.add((a[0], b[0], axis))
    frame = spark.createDataFrame(boxes, "id int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    got = [tuple(r) for r in neighbours.face_neighbours(frame).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_cloud_with_itself_by_half_of_the_cells(spark):
    xyz = np.random.default_rng(4).uniform(-2, 2, (300, 3))
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    got = [(r["a_id"], r["b_id"]) for r in neighbours.radius_join(frame, frame, 0.7).collect()]
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(d2 <= 0.49))))
    other = frame.select("*")
    assert sorted((r["a_id"], r["b_id"]) for r in neighbours.radius_join(frame, other, 0.7).collect()) == sorted(got)


def test_voxel_names_of_a_long_grid(spark):
    keys = spark.createDataFrame([(0, 1, 0), (0, 0, 1000), (1, 0, 0), (0, 1000, 0), (-1, 1000, 1000)], "vx long, vy long, vz long")
    assert keys.select(voxels.voxel_name().alias("n")).distinct().count() == 5


def test_growth_over_leaves_takes_single_points(spark):
    """Two leaves of a floor, a sparse one beside them with points on and off the floor, and a wall that a stronger peak takes."""
    leaves = [("a", "cop", 0.0, 0.0, 1.0, 0.5, 0.5, 0.0), ("b", "cop", 0.0, 0.05, 0.999, 1.5, 0.5, 0.0), ("s", "spa", None, None, None, 2.5, 0.5, 0.2), ("w", "cop", 1.0, 0.0, 0.0, 3.0, 0.5, 0.5), ("far", "cop", 0.0, 0.0, 1.0, 0.5, 0.5, 3.0)]
    beside = [("a", "b"), ("b", "s"), ("s", "w"), ("a", "far")]
    points = [(1, "a", 0.5, 0.5, 0.0, 0.0, 0.0, 1.0), (2, "b", 1.5, 0.5, 0.01, 0.0, 0.0, 1.0), (3, "s", 2.4, 0.5, 0.02, 0.0, 0.0, -1.0), (4, "s", 2.4, 0.5, 0.9, 0.0, 0.0, 1.0), (5, "s", 2.4, 0.5, 0.0, 1.0, 0.0, 0.0), (6, "w", 3.0, 0.5, 0.5, 1.0, 0.0, 0.0), (7, "far", 0.5, 0.5, 3.0, 0.0, 0.0, 1.0)]
    frame = spark.createDataFrame(leaves, "leaf string, kind string, a double, b double, c double, cx double, cy double, cz double")
    edges = spark.createDataFrame(beside + [(b, a) for a, b in beside], "a string, b string")
    p = spark.createDataFrame(points, "point_id long, leaf string, x double, y double, z double, nx double, ny double, nz double")
    peaks = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 5.0), (90, 1.0, 0.0, 0.0, 2.0)], "peak int, mx double, my double, mz double, votes double")
    got = {r["point_id"]: r["peak"] for r in growth.leaf_growth(frame, edges, p, peaks, 2.0, 20.0, 10.0, 0.1).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 6: 90}


def test_hull_filter_keeps_the_largest_part(spark):
    g = [(0.5 + i, 0.5 + j) for i in range(6) for j in range(4)]
    rows = [(n, 0, x, y, 0.0) for n, (x, y) in enumerate(g)] + [(100 + n, 0, 40.5 + n, 0.5, 0.0) for n in range(5)] + [(200, 0, 3.01, 2.02, 0.0)]
    p = spark.createDataFrame(rows, "point_id long, key int, x double, y double, z double")
    fits = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)], "key int, a double, b double, c double, d double, cx double, cy double, cz double")
    got = {r["point_id"] for r in polygons.hull_filter(p, "key", fits, 1.0).collect()}
    assert got == {*range(24), 200}


def test_seeded_colours_are_the_generators(spark):
    got = {r["k"]: (r["dr"], r["dg"], r["db"]) for r in converters.seeded_colours(spark.createDataFrame([(1,), (1,), (7,), (None,)], "k long"), "k").collect()}
    assert got == {None: (None, None, None), **{k: tuple(int(v) for v in np.random.default_rng(k + 12345).integers(0, 256, 3)) for k in (1, 7)}}


def test_quantile_edges_rise(spark):
    v = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 0, 1, 1, 2, 9]], "v double")
    edges = [r["edge"] for r in statistics.quantile_edges(v, "v", 8).orderBy("k").collect()]
    assert all(b > a for a, b in zip(edges, edges[1:])) and edges[0] == 0 and edges[-1] == 9
    assert np.allclose(edges, np.quantile([0, 0, 0, 0, 1, 1, 2, 9], np.linspace(0, 1, 9)), atol=1e-9)


def test_written_tables_are_released(spark):
    df = written(spark.range(3), "kept")
    assert df.count() == 3 and shared_folder(spark) in df.inputFiles()[0]
    assert release(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count()
