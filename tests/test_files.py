"""Readers and writers: round trips and hand-made files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoplane.sources import pointfiles, sinks


def ply(tmp_path, order, kind):
    xyz = np.arange(12, dtype=float).reshape(4, 3)
    head = f"ply\nformat {order} 1.0\ncomment x\nelement vertex 4\nproperty double x\nproperty double y\nproperty double z\nproperty uchar r\nproperty float scalar_facet_id\nproperty float normal_x\nend_header\n".encode()
    rec = np.dtype([("x", kind + "f8"), ("y", kind + "f8"), ("z", kind + "f8"), ("r", "u1"), ("s", kind + "f4"), ("n", kind + "f4")])
    rows = np.zeros(4, rec)
    rows["x"], rows["y"], rows["z"] = xyz.T
    rows["r"], rows["s"] = [1, 2, 3, 255], [0.5, 1, 2, 3]
    body = rows.tobytes() if order != "ascii" else "\n".join(" ".join(map(str, r)) for r in rows.tolist()).encode() + b"\n"
    at = tmp_path / f"{order}.ply"
    at.write_bytes(head + body)
    return str(at)


@pytest.mark.parametrize("order,kind", [("ascii", "<"), ("binary_little_endian", "<"), ("binary_big_endian", ">")])
def test_ply(spark, tmp_path, order, kind, monkeypatch):
    df = pointfiles.read_points(spark, ply(tmp_path, order, kind))
    assert df.columns == ["point_id", "x", "y", "z", "red", "scalar_facet_id", "nx"]
    rows = df.orderBy("point_id").collect()
    assert [tuple(r)[:5] for r in rows] == [(0, 0.0, 1.0, 2.0, 1), (1, 3.0, 4.0, 5.0, 2), (2, 6.0, 7.0, 8.0, 3), (3, 9.0, 10.0, 11.0, 255)]
    full = pointfiles.with_defaults(df, extras=True).orderBy("point_id").first()
    assert full["ny"] is None and full["green"] == 0 and full["features"] == {"scalar_facet_id": 0.5}


def test_las(spark, tmp_path):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 2, 26, 3)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    body = b"".join(struct.pack("<iiiHBBbBHHHH", 100 * k, 200, 300, 7, 0, 2, 0, 0, 1, 65535, k, 0) for k in range(3))
    at = tmp_path / "a.las"
    at.write_bytes(bytes(head) + body)
    rows = pointfiles.read_points(spark, str(at)).orderBy("point_id").collect()
    assert [(r["x"], r["y"], r["z"], r["red"], r["green"]) for r in rows] == [(10.0 + k, 22.0, 33.0, 65535, k) for k in range(3)]
    head[104] |= 0x80
    (tmp_path / "a.laz").write_bytes(bytes(head))
    with pytest.raises(Exception, match="LAZ"):
        pointfiles.read_points(spark, str(tmp_path / "a.laz")).collect()
    with pytest.raises(ValueError):
        pointfiles.read_points(spark, "a.e57")


def test_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# c\n1 2 3 0 0 1 10 20 30\n\n4 5 6 0.5 -1 0 255 0 7 # end\n")
    assert pointfiles.read_points(spark, str(tmp_path / "a.xyz")).columns == ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"]
    (tmp_path / "b.txt").write_text("1,2,3,9.5\n4,5,6,8.5\n")
    assert pointfiles.read_points(spark, str(tmp_path / "b.txt")).columns == ["x", "y", "z", "attr3"]


def test_headed_and_numbered_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("//X,Y,Z,R,G,B,Dip (degrees),Nx\n1,2,3,4,5,6,30.5,0.1\n")
    r = pointfiles.read_points(spark, str(tmp_path / "h.csv")).first().asDict()
    assert r["X"] == 1 and r["dip"] == 30.5
    for k in (1, 2, 7):
        (tmp_path / f"s_discontinuity_{k:06d}.csv").write_text("X,Y\n" + "1,2\n" * k)
    got = pointfiles.read_numbered_folder(spark, f"{tmp_path}/s_*.csv").groupBy("disc_id").count().collect()
    assert {r["disc_id"]: r["count"] for r in got} == {1: 1, 2: 2, -1: 7}
    (tmp_path / "d.txt").write_text("1 2 3 4 5 6 7 8 9\n1 2\nx y z 1 1 1 1 1 1\n 9\t8 7 6 5 4 3 2 1\n")
    names = "X Y Z js cl A B C D".split()
    assert [r["X"] for r in pointfiles.read_spaced(spark, str(tmp_path / "d.txt"), names).orderBy("line_no").collect()] == [1, 9]
    with pytest.raises(ValueError):
        pointfiles.read_spaced(spark, str(tmp_path / "d.txt"), names, strict=True)


def test_ply_is_read_as_written(spark, tmp_path):
    points = spark.range(50).select(F.col("id").alias("point_id"), (F.col("id") * 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("id") % 256).cast("int").alias("red"))
    faces = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "v0 long, v1 long, v2 long")
    out = str(tmp_path / "out")
    sinks.write_ply(sinks.ply_text(points, "point_id", ["x", "y", "z", "red"], faces=faces), out)
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = tmp_path / "whole.ply"
    whole.write_bytes(b"".join(p.read_bytes() for p in parts))
    back = pointfiles.read_points(spark, str(whole)).orderBy("point_id").collect()
    assert [(r["x"], r["red"]) for r in back] == [(k * 0.5, k % 256) for k in range(50)]


def test_export_all(spark, tmp_path):
    class Settings:
        def __init__(self):
            self.size, self.many = 2.0, list(range(80))

    at = sinks.export_all(str(tmp_path), "run", {"t": spark.range(3)}, Settings())
    assert spark.read.parquet(f"{at}/t.parquet").count() == 3
    assert spark.read.text(f"{at}/parameters").first()[0] == '{"many": {"length": 80}, "size": 2.0}'
