import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoplane.functions.planefit import plane_fit
from stratoplane.operators import orientation_clusters as O
from stratoplane.operators.ransac import detect_planes
from stratoplane.sources import converters, synthetic


def test_known_clouds(spark):
    f = plane_fit(synthetic.noisy_plane(spark), []).first()
    n = np.array([-0.2, -0.1, 1.0]) / np.linalg.norm([-0.2, -0.1, 1.0])
    assert abs(n @ [f["a"], f["b"], f["c"]]) > 0.9999 and f["rmse"] < 0.012
    cloud = synthetic.plane_with_outliers(spark, 2000)
    planes, _ = detect_planes(cloud.select("point_id", "x", "y", "z"), 0.05, 500, 80, 1)
    best, truth = planes.first(), np.array([0.2, -0.3, 0.93]) / np.linalg.norm([0.2, -0.3, 0.93])
    assert abs(truth @ [best["a"], best["b"], best["c"]]) > 0.998 and cloud.where("outlier").count() == 500


def test_facet_tables(spark):
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None), (5, 9)], "point_id long, facet_id long")
    labels = spark.createDataFrame([(5, 2.0), (6, 2.0), (6, 2.0)], "facet_id long, cluster_id double")
    got = {r["point_id"]: (r["cluster_id"], r["sub_id"]) for r in converters.facet_tables(points, labels).collect()}
    assert got[1] == got[2] == (2, 1) and got[3] == (2, 2) and got[4][0] == got[5][0] == -1
    with pytest.raises(ValueError, match="Z"):
        converters.range_profile(points, ["point_id", "Z"])


def test_ranks_of_empty_and_tied_rows(spark):
    none = spark.createDataFrame([], "disc_id long, q double")
    assert O.ranked(none, [F.desc("q"), F.col("disc_id")], "q").count() == 0
    tied = spark.createDataFrame([(i, 1.0) for i in range(50)], "disc_id long, q double")
    assert [r["rank"] for r in O.ranked(tied, [F.desc("q"), F.col("disc_id")], "q").orderBy("disc_id").collect()] == list(range(1, 51))


def test_seeds_and_merges():
    centres = [(0.0, 0.0, 1.0), (0.0, 0.1, 0.995), (1.0, 0.0, 0.0)]
    merged, number = O.merge_centres(centres, [1, 1, 1], 10.0, 5)
    assert len(merged) == 2 and number == [1, 1, 0] and O.merge_centres(centres, [1, 1, 1], 10.0, 0)[1] == [0, 1, 2]
    kept = O.with_seeds([(0.0, 0.0, 1.0)], [(0.0, 0.05, 0.998), (1.0, 0.0, 0.0), (0.999, 0.04, 0.0)], 10.0)
    assert [k[3] for k in kept] == [False, True]


def test_fuzzy_clustering_runs_to_the_tolerance(spark, monkeypatch):
    from stratoplane.plans import orientation_queries as Q

    seen = {}

    def spy(name):
        plain = getattr(O, name)
        monkeypatch.setattr(O, name, lambda *a, **b: seen.setdefault(name, []).append((a, b, out := plain(*a, **b))) or out)
        return plain

    again, _, _ = spy("fuzzy_c_means"), spy("angular_dbscan"), spy("merge_centres")
    rows = Q.fuzzy_clustering(spark, "/root/testdata/sf0.001").collect()
    (layer, _, least), _, _ = seen["angular_dbscan"][0]
    assert least == max(3, round(0.05 * layer.count())) > 4 and len(rows) == 500
    (data, *_), _, (member, centres) = seen["fuzzy_c_means"][0]
    _, moved = again(data, centres, rounds=1)
    assert max(np.degrees(np.arccos(min(1.0, abs(float(np.dot(a, b)))))) for a, b in zip(centres, moved)) < 0.01
    mass = seen["merge_centres"][0][0][1]
    pdf = member.toPandas()
    want = (pdf["alpha"] * pdf["mu"] ** 2).groupby(pdf["k"]).sum()
    assert np.allclose(mass, [want[k] for k in range(len(centres))])
