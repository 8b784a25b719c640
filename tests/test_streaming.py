import pytest
from pyspark.sql import functions as F

from stratoplane.functions.planefit import plane_fit
from stratoplane.operators.voxels import KEY
from stratoplane.plans.fixtures import pts
from stratoplane.streaming.voxel_planes import follow, voxel_planes

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r[k] for k in KEY): r for r in df.collect()}


def test_sums_give_the_two_pass_fits(spark):
    p = pts(spark, FOLDER)
    keyed = p.withColumns({f"v{c}": F.floor(F.col(c) / 5.0).cast("long") for c in "xyz"})
    want, got = rows(plane_fit(keyed, KEY)), rows(voxel_planes(p, 5.0))
    assert want.keys() == got.keys()
    for k, w in want.items():
        assert got[k]["n"] == w["n"]
        if w["n"] > 10:
            assert [got[k][c] for c in ("a", "b", "c", "d", "rmse")] == pytest.approx([w[c] for c in ("a", "b", "c", "d", "rmse")], abs=1e-6)


def test_stream_follows_arriving_points(spark, tmp_path):
    p = pts(spark, FOLDER).select("point_id", "x", "y", "z")
    source = str(tmp_path / "in")
    for part in range(2):
        p.where(F.col("point_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = follow(stream, 5.0, "followed")
    query.processAllAvailable()
    query.stop()
    last = spark.table("followed").groupBy(*KEY).agg(F.max("n").alias("n"))
    assert {k: r["n"] for k, r in rows(last).items()} == {k: r["n"] for k, r in rows(voxel_planes(p, 5.0)).items()}
