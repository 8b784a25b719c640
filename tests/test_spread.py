"""No task holds what grows with a cloud: files in several parts, filters and scores without groups or rows of pairs."""

import glob
import os

import numpy as np

from stratoplane.functions.planefit import plane_fit
from stratoplane.operators import polygons, ransac
from stratoplane.plans import file_queries
from stratoplane.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_an_order_stay_in_their_parts(spark, tmp_path):
    sinks.write_csv(spark.range(0, 4000, 1, 4), f"{tmp_path}/t.csv", "N")
    parts = [open(p).read().split() for p in sorted(glob.glob(f"{tmp_path}/t.csv/part-*"))]
    assert [x for p in parts for x in p] == ["N", *map(str, range(4000))] and max(map(len, parts)) <= 1000


def test_files_that_are_read_back_have_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(file_queries, "pts", lambda spark, sf, f=file_queries.pts: f(spark, sf).repartition(4))
    for query, at in ((file_queries.pcd_cloud, "cloud.pcd"), (file_queries.commented_header, "headed.csv")):
        assert query(spark, FOLDER).count() == 1000
        sizes = [os.path.getsize(p) for p in glob.glob(f"{tmp_path}/{at}/part*")]
        assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_points_are_filtered_by_hulls_without_a_group(spark):
    p = spark.range(400).selectExpr("id AS point_id", "id % 2 AS key", "double(id % 20) AS x", "double(id DIV 20) AS y", "double(0) AS z")
    kept = polygons.hull_filter(p, "key", plane_fit(p, ["key"]), 3.0)
    assert "FlatMapGroups" not in plan(kept) and 0 < kept.count() < 400


def test_scores_are_no_rows_of_pairs(spark):
    xyz = np.random.default_rng(3).uniform(-1, 1, (500, 3))
    p = spark.createDataFrame([(i, *map(float, q), float(i % 3)) for i, q in enumerate(xyz)], "point_id long, x double, y double, z double, w double")
    cand = spark.createDataFrame([(k, 0.6, 0.0, 0.8, k / 10) for k in range(7)], "cand int, a double, b double, c double, d double")
    s = ransac.scores(p, cand, 0.2, 0.1, "w")
    assert "NestedLoop" not in plan(s)
    d = np.abs(xyz @ [0.6, 0, 0.8] + np.arange(7)[:, None] / 10)
    want = {k: ((d[k] <= 0.2).sum(), (np.arange(500) % 3 * np.exp(-d[k] ** 2 / 0.02)).sum()) for k in range(7)}
    assert all(r["inliers"] == want[r["cand"]][0] and abs(r["score"] - want[r["cand"]][1]) < 1e-9 for r in s.collect())
