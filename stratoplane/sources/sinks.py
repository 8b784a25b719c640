"""Writers: canonical tables, PLY text, polygon meshes, voxel folders, parameters, and all of a run at once.

Tables are written by Spark's writers. A PLY file is one ordered text: its header counts the rows that are written, and its body
is a range-ordered text output, so that no task holds a cloud.
"""

import io
import json
import uuid
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dip, dip_direction, id_colour, plane_distance, vec
from ..operators.orientation_clusters import ranked
from ..operators.voxels import KEY
from ..shared_store import written


def point_table(members: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    """The canonical 22 columns: membership (point_id, disc_id, seg_id, cluster_id) with points and segment planes."""
    have = set(points.columns)
    own = lambda c, other: F.col(c) if c in have else F.lit(other)
    p = points.select("point_id", *(F.col(c).alias(c.upper()) for c in "xyz"), *(own(c, None).cast("double").alias(c) for c in ("nx", "ny", "nz")),
                      *(F.coalesce(own(c, 0).cast("int"), F.lit(0)).alias(n) for c, n in (("red", "R"), ("green", "G"), ("blue", "B"))), own("curvature", 0.0).cast("double").alias("Curvature"))
    s = segments.select("disc_id", "seg_id", *(F.col(c).alias(f"p{c}") for c in "abcd"), "rmse")
    j = members.join(p, "point_id").join(s, ["disc_id", "seg_id"])
    red, green, blue = id_colour(F.col("disc_id"))
    dist = F.abs(plane_distance(vec("pa", "pb", "pc"), F.col("pd"), vec("X", "Y", "Z")))
    named = {"X": "X", "Y": "Y", "Z": "Z", "nx": "nx", "ny": "ny", "nz": "nz", "R": "R", "G": "G", "B": "B"}
    return j.select(
        *(F.col(c).alias(n) for c, n in named.items()), red.alias("DR"), green.alias("DG"), blue.alias("DB"),
        F.col("disc_id").alias("Discontinuity_id"), F.col("cluster_id").alias("Cluster_id"), F.col("seg_id").alias("Segment_id"),
        F.col("pa").alias("A_plane"), F.col("pb").alias("B_plane"), F.col("pc").alias("C_plane"), F.col("pd").alias("D_plane"),
        F.col("rmse").alias("RMS"), "Curvature", dist.alias("DistToPlane"),
    )


#: Spark's column names do not tell B (blue) from b by case, nor two B apart; files carry these names.
POINT_HEADER = "X,Y,Z,nx,ny,nz,R,G,B,DR,DG,DB,Discontinuity_id,Cluster_id,Segment_id,A,B,C,D,RMS,Curvature,DistToPlane"


def discontinuity_table(members: DataFrame, segments: DataFrame, planes: DataFrame, geometry: DataFrame) -> DataFrame:
    """One row per discontinuity: orientation, plane, distinct points, area, trace, roughness, mean RMS over segments."""
    count = members.groupBy("disc_id").agg(F.count_distinct("point_id").alias("PointsNumber"), F.max("cluster_id").alias("Cluster_id"))
    rms = segments.groupBy("disc_id").agg(F.avg("rmse").alias("MeanRMS"))
    n = vec("a", "b", "c")
    out = planes.join(count, "disc_id").join(rms, "disc_id", "left").join(geometry.select("disc_id", "area", "trace"), "disc_id", "left")
    return out.select(
        F.col("disc_id").alias("Discontinuity_id"), "Cluster_id", dip(n).alias("Dip"), dip_direction(n).alias("Dipdir"), F.col("a").alias("A"), F.col("b").alias("B"), F.col("c").alias("C"), F.col("d").alias("D"),
        "PointsNumber", F.coalesce("area", F.lit(0.0)).alias("Area"), F.coalesce("trace", F.lit(0.0)).alias("TraceLength"), F.col("rmse").alias("Roughness"), "MeanRMS",
    )


def cluster_table(centres: DataFrame) -> DataFrame:
    """Cluster_id, Dip and Dipdir with two decimals, members, confidence, is_manual_seed from (k, mx, my, mz, members, ...)."""
    n = vec("mx", "my", "mz")
    return centres.select(F.col("k").alias("Cluster_id"), F.format_string("%.2f", dip(n)).alias("Dip"), F.format_string("%.2f", dip_direction(n)).alias("Dipdir"), F.col("members").alias("Discontinuity_Number"), "confidence", "is_manual_seed")


def _line(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *(c.cast("string") for c in columns))


def csv_lines(df: DataFrame) -> Column:
    """A row as a CSV line; text with commas, quotes or line breaks is quoted, NULL is empty."""
    def field(c: str, kind: str) -> Column:
        v = F.col(c).cast("string")
        if kind == "string":
            v = F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
        return F.coalesce(v, F.lit(""))

    return F.concat_ws(",", *(field(f"`{c}`", k) for c, k in df.dtypes))


def write_csv(df: DataFrame, path: str, header: str | None = None, order: list[str] = ()) -> None:
    """A folder of CSV parts that are one file in the order of their names: the header line, which may have names that Spark does not
    allow, and the rows by ``order``. What was there is replaced."""
    names = header or ",".join(df.columns)
    body = df.withColumn("_line", csv_lines(df))
    keys = [F.col(c) for c in order]
    head = df.sparkSession.range(0, 1, 1, 1).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order), F.lit(names).alias("_line"), F.lit(0).alias("_part"))
    every = head.unionByName(body.select(*order, "_line", F.lit(1).alias("_part")))
    if keys:
        every = every.orderBy("_part", *keys)
    # Without an order the parts stay as they are, the header's before the rows': sorted by _part alone all rows would be one task's.
    every.select("_line").write.mode("overwrite").text(path)


def created(path: str):
    """An output stream on a path or address; what was there is replaced."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    else:
        store, inner = fs.LocalFileSystem(), path
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


#: Struct codes and PLY names of Spark types in binary files.
_BINARY_OF = {"float": ("f", "float"), "double": ("d", "double"), "int": ("i", "int"), "bigint": ("i", "int"), "smallint": ("h", "short"), "tinyint": ("b", "char")}


def write_group_files(df: DataFrame, key: str, order: str, folder: str, pattern: str, columns: list[str], form: str = "csv", header: str | None = None) -> DataFrame:
    """One file for each value of the integer column ``key``, rows in ``order``: CSV, ASCII PLY or binary little-endian PLY. Returns a
    table of file names and rows.

    pattern is a name such as ``discontinuity_%06d.csv``. A file is one stream of one task that never holds more than a batch; tasks
    that run again write the same file anew. Bytes of 0 to 255 named red, green or blue are uchar in PLY."""
    kinds, uchar = dict(df.dtypes), {"red", "green", "blue"}
    counted = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    rows = df.select(key, order, *(F.col(c).alias(f"_c{k}") for k, c in enumerate(columns))).join(counted, key)
    line = F.concat_ws("," if form == "csv" else " ", *(F.coalesce(F.col(f"_c{k}").cast("string"), F.lit("")) for k in range(len(columns))))
    if form != "binary":
        rows = rows.select(key, order, "_n", F.concat(line, F.lit("\n")).alias("_line"))
    codes = "<" + "".join("B" if c in uchar else _BINARY_OF[kinds[c]][0] for c in columns) if form == "binary" else ""
    props = [f"property {'uchar' if c in uchar else _BINARY_OF.get(kinds[c], ('', 'float'))[1]} {c}" for c in columns]
    names = header or ",".join(columns)

    def head(n: int) -> bytes:
        if form == "csv":
            return (names + "\n").encode()
        return "\n".join(["ply", f"format {'ascii' if form == 'ply' else 'binary_little_endian'} 1.0", f"element vertex {n}", *props, "end_header\n"]).encode()

    def packed(b: pa.RecordBatch) -> np.ndarray:
        """The batch as binary records; values that a field cannot hold raise, as do NULLs."""
        kind = np.dtype([(f"f{k}", "<" + ("u1" if t == "B" else t)) for k, t in enumerate(codes[1:])])
        out = np.empty(b.num_rows, kind)
        for k, f in enumerate(kind.names):
            values = b.column(k + 3)
            if values.null_count:
                raise ValueError(f"{columns[k]} has NULLs")
            out[f] = values.cast(pa.from_numpy_dtype(kind[f]), safe=kind[f].kind in "iu").to_numpy(zero_copy_only=False)
        return out

    def write(batches):
        now, stream, done = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys, n = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            values = packed(b) if form == "binary" else b.column(3)
            for lo, hi in zip(cuts, cuts[1:]):
                if stream is None or int(keys[lo]) != now:
                    if stream is not None:
                        stream.close()
                    now = int(keys[lo])
                    stream = created(f"{folder}/{pattern % now}")
                    stream.write(head(n[lo].as_py()))
                    done.append((pattern % now, n[lo].as_py()))
                stream.write(values[lo:hi].tobytes() if form == "binary" else "".join(values.slice(lo, hi - lo).to_pylist()).encode())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file_name", "num_points"])

    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    first = [key, order, "_n"]
    return written(dealt.select(*first, *(c for c in dealt.columns if c not in first)).mapInArrow(write, "file_name string, num_points long"), "files")


def write_npy_samples(df: DataFrame, keys: list[str], order: str, folder: str, arrays: dict[str, list[str]]) -> DataFrame:
    """Sample folders for training: for each group a folder named by its keys with one .npy file for each array of columns, rows in
    ``order``. Groups are tiles with a bounded number of points. Returns folder names and rows."""
    need = sorted({c for cs in arrays.values() for c in cs})

    def write(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by(order)
        name = "_".join(str(group.column(k)[0].as_py()) for k in keys)
        for array, columns in arrays.items():
            out = io.BytesIO()
            whole = np.stack([group.column(c).to_numpy() for c in columns], axis=1)
            np.save(out, whole[:, 0] if len(columns) == 1 else whole.astype(np.float32))
            with created(f"{folder}/{name}/{array}.npy") as stream:
                stream.write(out.getvalue())
        return pa.table({"sample": [name], "num_points": [len(group)]})

    return written(df.select(*keys, order, *(c for c in need if c not in (*keys, order))).groupBy(*keys).applyInArrow(write, "sample string, num_points long"), "samples")


#: PLY names of Spark types.
_PLY_OF = {"float": "float", "double": "double", "int": "int", "smallint": "short", "tinyint": "char", "bigint": "int"}


def ply_text(vertices: DataFrame, order: str, columns: list[str], faces: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The lines of an ASCII PLY as (part, at, value): header, vertices by ``order``, then edges (v1, v2) and faces (v0, v1, v2)."""
    kinds, spark = dict(vertices.dtypes), vertices.sparkSession
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *(f"property {_PLY_OF[kinds[c]]} {c}" for c in columns)]
    if edges is not None:
        head += [f"element edge {edges.count()}", "property int vertex1", "property int vertex2"]
    if faces is not None:
        head += [f"element face {faces.count()}", "property list uchar int vertex_indices"]
    text = spark.createDataFrame([(0, k, v) for k, v in enumerate([*head, "end_header"])], "part int, at long, value string")
    text = text.unionByName(vertices.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("at"), _line([F.col(c) for c in columns]).alias("value")))
    if edges is not None:
        text = text.unionByName(edges.select(F.lit(2).alias("part"), F.col("v1").cast("long").alias("at"), _line([F.col("v1"), F.col("v2")]).alias("value")))
    if faces is not None:
        text = text.unionByName(faces.select(F.lit(3).alias("part"), F.col("v1").cast("long").alias("at"), _line([F.lit(3), F.col("v0"), F.col("v1"), F.col("v2")]).alias("value")))
    return text


def write_ply(text: DataFrame, path: str) -> None:
    """Ordered part files; their concatenation by name is the PLY file."""
    text.orderBy("part", "at").select("value").write.mode("overwrite").text(path)


def polygon_ply(corners: DataFrame, key: str) -> DataFrame:
    """The lines of a PLY of polygons from their corners (key, k, x, y, z): for each polygon its centroid and its corners, a fan of
    triangles around the centroid, and the closed boundary as edges. Corners number some hundred a polygon."""
    centre = corners.groupBy(key).agg(*(F.avg(c).alias(c) for c in "xyz")).withColumn("k", F.lit(-1).cast("long"))
    points = centre.select(key, "k", *"xyz").unionByName(corners.select(key, F.col("k").cast("long").alias("k"), *"xyz"))
    placed = written(ranked(points, [F.col(key), F.col("k")], key, "_place").withColumn("at", F.col("_place") - 1), "polygon-vertices")
    size = corners.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    first = placed.where("k = -1").select(key, F.col("at").alias("_c")).join(size, key)
    ring = placed.where("k >= 0").select(key, "k").join(first, key)
    v1, v2 = F.col("_c") + 1 + F.col("k"), F.col("_c") + 1 + F.pmod(F.col("k") + 1, F.col("_n"))
    sides = ring.select(F.col("_c").alias("v0"), v1.alias("v1"), v2.alias("v2"))
    return ply_text(placed, "at", ["x", "y", "z"], faces=sides, edges=sides.select("v1", "v2"))


def export_run(folder: str, name: str, members: DataFrame, points: DataFrame, segments: DataFrame, planes: DataFrame, geometry: DataFrame, centres: DataFrame, corners: DataFrame, settings=None) -> str:
    """All files of a run below folder/<stamp>_<name>: the point, discontinuity and cluster tables as CSV with their own headers,
    the polygons as PLY, a CSV and a PLY of the points of each discontinuity, and the settings as JSON. Gives the folder."""
    at = f"{folder.rstrip('/')}/{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:6]}_{name}"
    table = written(point_table(members, points, segments), "point-table")
    write_csv(table, f"{at}/{name}_points.csv", POINT_HEADER, ["Discontinuity_id", "X", "Y", "Z"])
    write_csv(discontinuity_table(members, segments, planes, geometry), f"{at}/{name}_discontinuities.csv", order=["Discontinuity_id"])
    write_csv(cluster_table(centres), f"{at}/{name}_clusters.csv", order=["Cluster_id"])
    write_ply(polygon_ply(corners, "disc_id"), f"{at}/{name}_polygons.ply")
    own = table.select(*"XYZ", "nx", "ny", "nz", F.col("DR").alias("red"), F.col("DG").alias("green"), F.col("DB").alias("blue"), F.col("Discontinuity_id").cast("long").alias("disc"))
    own = own.withColumns({c.lower(): F.col(c) for c in "XYZ"}).withColumn("_order", F.xxhash64(*"xyz"))
    columns = ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"]
    for form, suffix in (("csv", "csv"), ("ply", "ply")):
        write_group_files(own.select("disc", "_order", *columns).fillna(0.0, ["nx", "ny", "nz"]), "disc", "_order", f"{at}/discontinuities", f"discontinuity_%06d.{suffix}", columns, form)
    write_parameters(members.sparkSession, settings or {}, f"{at}/parameters")
    return at


def write_voxels(keyed: DataFrame, path: str) -> None:
    """A folder of Parquet files partitioned by voxel."""
    keyed.repartition(*KEY).write.mode("overwrite").partitionBy(*KEY).parquet(path)


def parameters(value, most: int = 50):
    """Anything as JSON values: records by their fields, long arrays by their length."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {str(k): parameters(v, most) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [parameters(v, most) for v in value] if len(value) <= most else {"length": len(value)}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return parameters(vars(value), most) if hasattr(value, "__dict__") else str(value)


def write_parameters(spark, value, path: str) -> None:
    spark.createDataFrame([(json.dumps(parameters(value), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_all(folder: str, name: str, tables: dict[str, DataFrame], settings=None) -> str:
    """Write the tables of a run below folder/<stamp>_<name>: Parquet and CSV for each, settings as JSON."""
    at = f"{folder.rstrip('/')}/{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:6]}_{name}"
    for key, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{key}.parquet")
        if not any(t.startswith(("array", "struct", "map", "binary")) for _, t in df.dtypes):
            df.write.mode("overwrite").option("header", "true").csv(f"{at}/{key}.csv")
    if settings is not None and tables:
        write_parameters(next(iter(tables.values())).sparkSession, settings, f"{at}/parameters")
    return at
