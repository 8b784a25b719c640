"""Queries that write files and read them back: text clouds, canonical tables, folders of numbered files, PLY, training samples."""

import uuid

from pyspark.sql import functions as F

from ..functions.planefit import plane_fit
from ..operators import voxels
from ..shared_store import shared_folder
from ..sources import pointfiles, sinks
from .fixtures import PTS, fit_sql, pts, q6, r6, vox, vox_sql
from .plot_queries import _H1, _RING, _SEG, _TL, rings, segment_tables, tiled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_XYZ = ", ".join(f"{q6(c)} AS {c}" for c in "xyz")


def xyz():
    return (r6(c).alias(c) for c in "xyz")


@query(f"WITH {PTS} SELECT {_XYZ}, 0e0 AS nx, 1e0 AS nz, CAST(point_id % 256 AS DOUBLE) AS red, CAST(user_id % 200 AS DOUBLE) AS blue FROM pts")
def text_cloud(spark, sf):
    """A text cloud without a header: normals and colours are told by their values."""
    at = folder(spark, "cloud") + ".xyz"
    p = pts(spark, sf)
    p.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"), F.lit("0.0 0.0 1.0"), *((F.col(c) % m).cast("string") for c, m in (("point_id", 256), ("point_id", 7), ("user_id", 200))))).write.text(at)
    back = pointfiles.read_points(spark, at)
    return back.select(*xyz(), "nx", "nz", "red", "blue")


@query(f"""WITH {PTS}, {fit_sql('pts', ['fam'])} SELECT point_id, {_XYZ}, CAST(p.fam AS INTEGER) AS disc, CAST((37 * p.fam + 59) % 256 AS INTEGER) AS dr, {q6('f.b')} AS pb, {q6('rmse')} AS rms FROM pts p JOIN fit f USING (fam)""")
def canonical_csv(spark, sf):
    """The canonical point table written with its own header and read back by a fixed schema, some columns only."""
    p = pts(spark, sf).withColumn("disc_id", F.col("fam").cast("long")).withColumn("curvature", F.col("point_id").cast("double"))
    segments = plane_fit(p, ["disc_id"]).withColumn("seg_id", F.lit(0).cast("long"))
    members = p.select("point_id", "disc_id", F.lit(0).cast("long").alias("seg_id"), F.lit(0).cast("long").alias("cluster_id"))
    at = folder(spark, "points") + ".csv"
    sinks.write_csv(sinks.point_table(members, p, segments), at, sinks.POINT_HEADER)
    back = pointfiles.read_canonical(spark, at, ["X", "Y", "Z", "Discontinuity_id", "DR", "B_plane", "RMS", "Curvature"])
    return back.select(F.col("Curvature").cast("long").alias("point_id"), *(r6(c.upper()).alias(c) for c in "xyz"), F.col("Discontinuity_id").alias("disc"), F.col("DR").alias("dr"), r6("B_plane").alias("pb"), r6("RMS").alias("rms"))


def segment_files(spark, sf) -> str:
    """A folder of one CSV file for each user, named by number."""
    at = folder(spark, "segments")
    p = pts(spark, sf).withColumn("number", F.col("user_id"))
    sinks.write_group_files(p, "number", "point_id", at, "cloud_discontinuity_%06d.csv", ["x", "y", "z", "point_id"], header="//X,Y,Z,Id")
    return at


@query(f"WITH {PTS} SELECT point_id, {q6('x')} AS x, CASE WHEN user_id = (SELECT max(user_id) FROM pts) THEN -1 ELSE user_id END AS disc_id FROM pts")
def numbered_files(spark, sf):
    """Segment files of a folder, with ids from their names; the last is the background."""
    back = pointfiles.read_numbered_folder(spark, segment_files(spark, sf))
    return back.select(F.col("Id").cast("long").alias("point_id"), r6(F.col("`//X`").cast("double")).alias("x"), F.col("disc_id").cast("long").alias("disc_id"))


@query(f"WITH {PTS} SELECT printf('cloud_discontinuity_%06d.csv', user_id) AS file_name, count(*) AS n_rows FROM pts GROUP BY user_id")
def valid_row_counts(spark, sf):
    return pointfiles.valid_row_counts(spark, segment_files(spark, sf))


@query(f"WITH {PTS} SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY point_id) AS BIGINT) AS line_no, point_id, user_id AS number FROM pts")
def lines_in_file_order(spark, sf):
    """Rows in the order of files by number and of lines within them."""
    lines = pointfiles.numbered_lines(spark, segment_files(spark, sf)).where("line_no > 0")
    return lines.select("line_no", F.element_at(F.split("value", ","), 4).cast("long").alias("point_id"), F.regexp_extract("file", r"_(\d+)\.csv$", 1).cast("long").alias("number"))


@query(f"WITH {PTS} SELECT point_id, {_XYZ}, {q6('value')} AS dip FROM pts")
def commented_header(spark, sf):
    """A CSV whose header starts with // and names dips in words."""
    at = folder(spark, "headed") + ".csv"
    names = {"//X": "x", "Y": "y", "Z": "z", "Dip (degrees)": "value", "Id": "point_id"}
    # As many files as tasks, each with the header: one file would be one task's.
    pts(spark, sf).select(*(F.col(c).alias(n) for n, c in names.items())).write.option("header", "true").csv(at)
    back = pointfiles.read_headed(spark, at)
    return back.select(F.col("Id").cast("long").alias("point_id"), *(r6(c.upper()).alias(c) for c in "xyz"), r6("dip").alias("dip"))


@query(f"WITH {PTS} SELECT CAST(point_id AS BIGINT) AS line_id, {_XYZ}, CAST(fam AS DOUBLE) AS js FROM pts WHERE point_id % 10 <> 3")
def spaced_text(spark, sf):
    """Nine columns between blanks and tabs; rows that lack columns or have words are left out."""
    at = folder(spark, "spaced") + ".txt"
    p = pts(spark, sf)
    whole = F.concat(F.lit(" "), F.concat_ws("\t", *(F.col(c).cast("string") for c in "xyz")), F.lit("  "), F.concat_ws(" ", F.col("fam").cast("string"), F.col("point_id").cast("string"), F.lit("1 2 3 4")))
    p.select(F.when(F.col("point_id") % 20 == 3, F.lit("1 2 3")).when(F.col("point_id") % 10 == 3, F.lit("a b c d e f g h i")).otherwise(whole)).write.text(at)
    back = pointfiles.read_spaced(spark, at, "X Y Z js cl A D E H".split())
    return back.select(F.col("cl").cast("long").alias("line_id"), *(r6(c.upper()).alias(c) for c in "xyz"), "js")


_SINGLE = ", ".join(f"(round(CAST({c} AS DOUBLE), 4) + 0.0) AS {c}" for c in "xyz")


def single(c: str):
    return (F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c)


@query(f"WITH {PTS} SELECT fam, CAST(row_number() OVER (PARTITION BY fam ORDER BY point_id) - 1 AS BIGINT) AS place, {_SINGLE}, CAST(user_id AS BIGINT) AS facet_id, CAST((37 * fam + 59) % 256 AS INTEGER) AS red FROM pts")
def ascii_ply(spark, sf):
    """An ASCII PLY for each family, read back with its facet column under another name."""
    return _ply(spark, sf, "ply")


@query(f"WITH {PTS} SELECT fam, CAST(row_number() OVER (PARTITION BY fam ORDER BY point_id) - 1 AS BIGINT) AS place, {_SINGLE}, CAST(user_id AS BIGINT) AS facet_id, CAST((37 * fam + 59) % 256 AS INTEGER) AS red FROM pts")
def binary_ply(spark, sf):
    """A binary PLY with an instance id for each family, read back."""
    return _ply(spark, sf, "binary")


def _ply(spark, sf, form: str):
    from ..functions.vectors import id_colour

    red, green, blue = id_colour(F.col("fam"))
    p = pts(spark, sf).withColumns({"red": red, "green": green, "blue": blue, "scalar_facet_id": F.col("user_id").cast("double"), "nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    at = folder(spark, form)
    files = sinks.write_group_files(p, "fam", "point_id", at, "family_%03d.ply", ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue", "scalar_facet_id"], form)
    out = None
    for name in sorted(r["file_name"] for r in files.collect()):  # four files
        one = pointfiles.by_alias(pointfiles.read_points(spark, f"{at}/{name}"), {"facet_id": ["scalar_facet_id", "facet", "id"]})
        one = one.select(F.lit(int(name[7:10])).alias("fam"), F.col("point_id").alias("place"), *(single(c) for c in "xyz"), F.col("facet_id").cast("long").alias("facet_id"), F.col("red").cast("int").alias("red"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_TL}, s AS (SELECT *, {_H1} AS h, lab <> -1 AS onn, count(*) OVER (PARTITION BY tx, ty, tz) AS n, count(*) FILTER (WHERE lab <> -1) OVER (PARTITION BY tx, ty, tz) AS non FROM tl),
 q AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz, onn ORDER BY h, point_id) AS rk, CASE WHEN n <= 150 THEN n WHEN onn THEN floor(150e0 * non / n) ELSE 150 - floor(150e0 * non / n) END AS quota FROM s WHERE n >= 20)
 SELECT tx || '_' || ty || '_' || tz AS sample, count(*) AS num_points, CAST(sum(CASE WHEN lab <> -1 THEN 1 ELSE 0 END) AS BIGINT) AS structure, CAST(max(lab) AS BIGINT) AS top FROM q WHERE rk <= quota GROUP BY tx, ty, tz""")
def sample_folders(spark, sf):
    """Training samples of the tiles as folders of .npy files, looked up again by the reader's side."""
    import numpy as np
    import pyarrow as pa

    tiles = voxels.stratified_sample(tiled(spark, sf), "point_id", "lab", 150, 20)
    s = voxels.centred_sample(tiles, "lab").withColumn("instance", F.col("instance").cast("long"))
    at = folder(spark, "samples")
    done = sinks.write_npy_samples(s, ["tx", "ty", "tz"], "point_id", at, {"coord": ["x0", "y0", "z0"], "segment": ["segment"], "instance": ["instance"]})

    def read(batches):
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                coord, segment, instance = (np.load(pa.BufferReader(pointfiles.opened(f"{at}/{name}/{a}.npy").read())) for a in ("coord", "segment", "instance"))
                out.append((name, len(coord), int(segment.sum()), int(instance.max())))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))], names=["sample", "num_points", "structure", "top"])

    return done.select("sample").mapInArrow(read, "sample string, num_points long, structure long, top long")


@query(f"WITH {PTS}, {vox_sql()} SELECT vx, vy, vz, count(*) AS num_points, 'voxel_' || vx || '_' || vy || '_' || vz AS file_name FROM vox GROUP BY vx, vy, vz")
def voxel_folders(spark, sf):
    """Points in a folder for each voxel, counted again from the folders' names."""
    at = folder(spark, "voxels")
    sinks.write_voxels(vox(spark, sf).select("vx", "vy", "vz", "x", "y", "z"), at)
    back = spark.read.parquet(at).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("num_points"))
    name = F.concat_ws("_", F.lit("voxel"), "vx", "vy", "vz")
    return back.select(*(F.col(c).cast("long").alias(c) for c in ("vx", "vy", "vz")), "num_points", name.alias("file_name"))


def corners_of(spark, sf):
    return rings(spark, sf).select(F.col("fam").cast("long").alias("disc_id"), "k", F.col("u").alias("x"), F.col("v").alias("y"), F.col("fam").cast("double").alias("z"))


@query(f"""WITH {_RING}, o AS (SELECT fam, dense_rank() OVER (ORDER BY fam) - 1 AS p, k FROM rg)
 SELECT 'face' AS kind, CAST(9 * p + 1 + k AS BIGINT) AS v1, CAST(9 * p + 1 + (k + 1) % 8 AS BIGINT) AS v2, CAST(9 * p AS BIGINT) AS v0 FROM o
 UNION ALL SELECT 'edge', 9 * p + 1 + k, 9 * p + 1 + (k + 1) % 8, NULL FROM o""")
def polygon_mesh(spark, sf):
    """Faces and edges of the polygons' PLY as its lines say."""
    at = folder(spark, "polygons")
    sinks.write_ply(sinks.polygon_ply(corners_of(spark, sf), "disc_id"), at)
    number = F.transform(F.split("value", " "), lambda x: x.try_cast("long"))
    lines = spark.read.text(at).where("value RLIKE '^[0-9]+( [0-9]+)+$'").select(number.alias("v"))
    face = F.size("v") == 4
    return lines.select(F.when(face, "face").otherwise("edge").alias("kind"), F.when(face, F.col("v")[2]).otherwise(F.col("v")[0]).alias("v1"), F.when(face, F.col("v")[3]).otherwise(F.col("v")[1]).alias("v2"), F.when(face, F.col("v")[1]).alias("v0"))


@query(f"""WITH {_SEG}, c AS (SELECT fam, count(*) AS n FROM pts GROUP BY fam)
 SELECT 'points' AS file, count(*) AS n FROM pts UNION ALL SELECT 'discontinuities', count(*) FROM c UNION ALL SELECT 'clusters', 2 UNION ALL SELECT 'polygons', count(*) * 8 FROM c
 UNION ALL SELECT printf('discontinuity_%06d.csv', fam), n FROM c UNION ALL SELECT printf('discontinuity_%06d.ply', fam), n FROM c UNION ALL SELECT 'parameters', 1""")
def exported_run(spark, sf):
    """Rows of every file that the export of a run has left."""
    p, segments, members = segment_tables(spark, sf)
    p = p.withColumn("curvature", F.col("value"))
    ring = rings(spark, sf)
    from ..operators import polygons

    geometry = polygons.areas(ring, "fam").join(polygons.diameters(ring, "fam"), "fam").select(F.col("fam").cast("long").alias("disc_id"), "area", "trace")
    centres = spark.range(2).select(F.col("id").alias("k"), F.lit(0.0).alias("mx"), F.lit(0.6).alias("my"), F.lit(0.8).alias("mz"), F.lit(2).alias("members"), F.lit(0.9).alias("confidence"), F.lit(False).alias("is_manual_seed"))
    at = sinks.export_run(folder(spark, "runs"), "rock", members, p, segments, segments, geometry, centres, corners_of(spark, sf), {"size": 2.0})
    count = lambda df, name: df.select(F.lit(name).alias("file"), F.lit(1).alias("one")).groupBy("file").agg(F.count("one").alias("n"))
    out = count(pointfiles.read_canonical(spark, f"{at}/rock_points.csv", ["X"]), "points")
    for name in ("discontinuities", "clusters"):
        out = out.unionByName(count(spark.read.option("header", "true").csv(f"{at}/rock_{name}.csv"), name))
    out = out.unionByName(count(spark.read.text(f"{at}/rock_polygons.ply").where("value RLIKE '^3 [0-9]+ [0-9]+ [0-9]+$'"), "polygons"))
    files = pointfiles.valid_row_counts(spark, f"{at}/discontinuities/*.csv").select(F.col("file_name").alias("file"), F.col("n_rows").alias("n"))
    meshes = spark.read.text(f"{at}/discontinuities/*.ply").where("value RLIKE '^[-0-9]'").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(files).unionByName(meshes).unionByName(count(spark.read.text(f"{at}/parameters"), "parameters"))


@query(f"WITH {PTS} SELECT {_XYZ}, CAST(user_id AS DOUBLE) AS intensity FROM pts")
def pcd_cloud(spark, sf):
    """An ASCII point file with a header of fields."""
    at = folder(spark, "cloud")
    p = pts(spark, sf)
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS x y z intensity", "SIZE 8 8 8 8", "TYPE F F F F", "COUNT 1 1 1 1", f"WIDTH {p.count()}", "HEIGHT 1", "DATA ascii"]
    body = p.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"), F.col("user_id").cast("string")).alias("value"))
    # Part files in the order of their names are the file: the header's first, as a union keeps its sides' parts.
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(body).write.text(at + ".pcd")
    return pointfiles.read_points(spark, at + ".pcd").select(*xyz(), "intensity")
