"""PLY and LAS readers as Python data sources, split by byte ranges; column-inferring text reader.

    register(spark); spark.read.format("ply").load(path)

A file is cut into ranges of records, so large clouds are read by many tasks. Columns follow the file's header; names that mean
normals or colours are unified, all other fields keep theirs. The file store is the one that pyarrow finds for the path.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared_store import written

#: Scalar types of PLY headers and of LAS point formats.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ALIASES = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "r": "red", "g": "green", "b": "blue"}
_LAS_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_LAS_OLD = _LAS_BASE + [("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_LAS_NEW = _LAS_BASE + [("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
LAS_FORMATS = {
    0: _LAS_OLD, 1: _LAS_OLD + [("gps_time", "<f8")], 2: _LAS_OLD + _RGB, 3: _LAS_OLD + [("gps_time", "<f8")] + _RGB,
    6: _LAS_NEW, 7: _LAS_NEW + _RGB, 8: _LAS_NEW + _RGB + [("nir", "<u2")],
}
#: Records of a task; records of a batch.
RECORDS, BATCH = 2_000_000, 200_000


def opened(path: str):
    """A random-access stream on a path or address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return store.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _spark_type(code: str) -> str:
    return {"f4": "float", "f8": "double", "i1": "int", "u1": "int", "i2": "int", "u2": "int", "i4": "long", "u4": "long"}[code[-2:]]


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlyHeader:
    """Element sizes, the vertex record and where the body starts."""

    def __init__(self, path: str):
        with opened(path) as f:
            raw = b""
            while b"end_header" not in raw:
                more = f.read(4096)
                if not more:
                    raise ValueError(f"{path} has no PLY header")
                raw += more
        end = raw.index(b"\n", raw.index(b"end_header")) + 1
        self.start, self.format, self.fields, self.count = end, "", [], 0
        element, before = None, True
        for line in raw[:end].decode("ascii", "replace").split("\n"):
            w = line.split()
            if w[:1] == ["format"]:
                self.format = w[1]
            elif w[:1] == ["element"]:
                element = w[1]
                if element == "vertex":
                    self.count, before = int(w[2]), False
                elif before and int(w[2]):
                    raise ValueError("elements before the vertices are not supported")
            elif w[:1] == ["property"] and element == "vertex":
                if w[1] == "list":
                    raise ValueError("list properties of vertices are not supported")
                self.fields.append((w[2], PLY_TYPES[w[1]]))
        names = [n for n, _ in self.fields]
        if not {"x", "y", "z"} <= set(names):
            raise ValueError("a PLY cloud needs x, y and z")
        self.names = [ALIASES[n] if n in ALIASES and ALIASES[n] not in names else n for n in names]

    def record(self) -> np.dtype:
        order = ">" if self.format == "binary_big_endian" else "<"
        return np.dtype([(n, order + t if t[-1] != "1" else t) for n, t in self.fields])


class PlyReader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, str]]):
        self.path, self.columns = path, columns

    def partitions(self):
        head = PlyHeader(self.path)
        if head.format == "ascii":
            return [_Range(0, head.count)]
        return [_Range(k, min(head.count, k + RECORDS)) for k in range(0, head.count, RECORDS)] or [_Range(0, 0)]

    def _blocks(self, part):
        head = PlyHeader(self.path)
        with opened(self.path) as f:
            if head.format != "ascii":
                kind = head.record()
                f.seek(head.start + part.first * kind.itemsize)
                for k in range(part.first, part.last, BATCH):
                    n = min(BATCH, part.last - k)
                    yield k, np.frombuffer(f.read(n * kind.itemsize), kind, n)
                return
            f.seek(head.start)
            kind = np.dtype([(n, t) for n, t in head.fields])
            rest, k = b"", 0
            while k < head.count:
                more = f.read(1 << 22)
                lines = (rest + more).split(b"\n")
                rest = lines.pop() if more else b""
                rows = [tuple(x.split()[: len(head.fields)]) for x in lines if x.strip()][: head.count - k]
                if rows:
                    yield k, np.array([tuple(float(v) for v in r) for r in rows], [(n, "f8") for n, _ in head.fields]).astype(kind)
                    k += len(rows)
                if not more:
                    break

    def read(self, partition):
        names = PlyHeader(self.path).names
        for k, block in self._blocks(partition):
            by_name = {n: block[f] for n, f in zip(names, block.dtype.names)}
            columns = [pa.array(np.arange(k, k + len(block)))] + [pa.array(by_name[n].astype({"int": "i4", "long": "i8", "float": "f4", "double": "f8"}[t])) for n, t in self.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["point_id", *(n for n, _ in self.columns)])


class PlySource(DataSource):
    """PLY clouds: ascii, little- and big-endian; ``point_id`` is the vertex' place."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        head = PlyHeader(self.options["path"])
        self._columns = [(n, _spark_type(t)) for n, (_, t) in zip(head.names, head.fields)]
        return "point_id long, " + ", ".join(f"`{n}` {t}" for n, t in self._columns)

    def reader(self, schema):
        head = PlyHeader(self.options["path"])
        return PlyReader(self.options["path"], [(n, _spark_type(t)) for n, (_, t) in zip(head.names, head.fields)])


class LasHeader:
    def __init__(self, path: str):
        with opened(path) as f:
            raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        self.start = struct.unpack_from("<I", raw, 96)[0]
        code, self.size, old = struct.unpack_from("<BHI", raw, 104)
        if code & 0x80:
            raise ValueError("LAZ (compressed LAS) needs a decompressor that is not available; convert the file to LAS")
        if code not in LAS_FORMATS:
            raise ValueError(f"point format {code} is not supported")
        self.scale, self.offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
        self.count = old or (struct.unpack_from("<Q", raw, 247)[0] if raw[25] >= 4 else 0)
        self.fields = LAS_FORMATS[code]
        packed = np.dtype(self.fields)
        self.record = np.dtype({"names": list(packed.names), "formats": [packed[n] for n in packed.names], "offsets": [packed.fields[n][1] for n in packed.names], "itemsize": self.size})


class LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        n = LasHeader(self.path).count
        return [_Range(k, min(n, k + RECORDS)) for k in range(0, n, RECORDS)] or [_Range(0, 0)]

    def read(self, partition):
        head = LasHeader(self.path)
        with opened(self.path) as f:
            f.seek(head.start + partition.first * head.size)
            for k in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - k)
                block = np.frombuffer(f.read(n * head.size), head.record, n)
                xyz = [pa.array(block[c] * s + o) for c, s, o in zip("XYZ", head.scale, head.offset)]
                rest = [pa.array(block[c].astype("f8" if t.endswith("f8") else "i4")) for c, t in head.fields[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), *xyz, *rest], names=["point_id", "x", "y", "z", *(c for c, _ in head.fields[3:])])


class LasSource(DataSource):
    """Uncompressed LAS 1.2 to 1.4; coordinates scaled, colours as 16-bit values."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        rest = LasHeader(self.options["path"]).fields[3:]
        return "point_id long, x double, y double, z double, " + ", ".join(f"{c} {'double' if t.endswith('f8') else 'int'}" for c, t in rest)

    def reader(self, schema):
        return LasReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(LasSource)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """A header-less numeric text file: x, y, z and what its other columns look like.

    Columns 4 to 6 are normals if all their values lie within 1.1 of zero; the last three are colours if all are whole numbers from
    0 to 255 (within 0.001); others are attr3, attr4, ... One aggregate over all rows decides. Text after # is no data."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    rows = lines.select(F.transform(F.split("v", r"\s*,\s*|\s+"), lambda x: x.try_cast("double")).alias("c"))
    first = rows.agg(F.min(F.size("c")).alias("n")).first()
    n = first["n"] or 0
    if n < 3:
        raise ValueError("a text cloud needs at least three columns")
    at = lambda k: F.element_at("c", k + 1)
    tests = [F.bool_and(F.abs(at(k)) <= 1.1).alias(f"n{k}") for k in range(n)] + [F.bool_and((at(k) >= 0) & (at(k) <= 255) & (F.abs(at(k) - F.rint(at(k))) <= 1e-3)).alias(f"c{k}") for k in range(n)]
    found = rows.agg(*tests).first()
    names = {k: f"attr{k}" for k in range(3, n)} | dict(enumerate("xyz"))
    if n >= 6 and all(found[f"n{k}"] for k in (3, 4, 5)):
        names |= {3: "nx", 4: "ny", 5: "nz"}
    if n >= 6 and all(found[f"c{k}"] for k in range(n - 3, n)) and not any(names[k] in ("nx", "ny", "nz") for k in range(n - 3, n)):
        names |= {n - 3: "red", n - 2: "green", n - 1: "blue"}
    return rows.select(*(at(k).alias(names[k]) for k in range(n)))


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """An ASCII PCD file: the columns that its FIELDS line names, as doubles; any number of tasks read its rows."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    head = {r["v"].split(" ", 1)[0].upper(): r["v"] for r in lines.where("v RLIKE '^(FIELDS|DATA|fields|data) '").limit(4).collect()}
    if "FIELDS" not in head or head.get("DATA", "").split()[-1:] != ["ascii"]:
        raise ValueError(f"{path} is not an ASCII PCD file")
    names = head["FIELDS"].split()[1:]
    rows = lines.where("v RLIKE '^[-+.0-9nN]'").select(F.split("v", r"\s+").alias("c"))
    return rows.select(*(F.get("c", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A cloud by its suffix: .ply, .las, .pcd (ASCII), .xyz, .txt, .csv (with or without a header)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("ply", "las", "laz"):
        register(spark)
        return spark.read.format("ply" if suffix == "ply" else "las").load(path)
    if suffix in ("xyz", "txt"):
        return read_xyz(spark, path)
    if suffix == "pcd":
        return read_pcd(spark, path)
    if suffix == "csv":
        head = spark.read.text(path).first()
        if head and any(ch.isalpha() for ch in head[0]):
            return read_headed(spark, path)
        return read_xyz(spark, path)
    raise ValueError(f"no reader for .{suffix} files")


def with_defaults(points: DataFrame, extras: bool = False) -> DataFrame:
    """The standard point columns: missing colours are 0, missing normals NULL; other columns as a map if asked."""
    have = {c.lower(): c for c in points.columns}
    column = lambda c, other: F.col(have[c]).cast("double") if c in have else other
    out = [F.col(have[c]).cast("double").alias(c) for c in "xyz"]
    out += [column(c, F.lit(None).cast("double")).alias(c) for c in ("nx", "ny", "nz")]
    out += [F.coalesce(column(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("red", "green", "blue")]
    ident = [F.col(have["point_id"])] if "point_id" in have else []
    rest = [c for c in points.columns if c.lower() not in {"point_id", "x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"}]
    features = [F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.col(c).cast("double") for c in rest))).alias("features")] if extras and rest else []
    return points.select(*ident, *out, *features)


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that may start with //; names in any case; Dip columns as they are."""
    head = spark.read.text(path).first()
    names = [n.strip().lstrip("/").strip() for n in head[0].split(",")] if head else []
    body = spark.read.option("header", "true").csv(path)
    rename = {"Dip (degrees)": "dip", "Dip direction (degrees)": "dip_dir"}
    return body.select(*(F.col(f"`{old}`").try_cast("double").alias(rename.get(new, new)) for old, new in zip(body.columns, names)))


def read_numbered_folder(spark: SparkSession, folder: str, pattern: str = r"discontinuity_(\d+)\.csv$") -> DataFrame:
    """All numbered segment files of a folder with disc_id from the name; the last number is the background, -1."""
    body = spark.read.option("header", "true").csv(folder).select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("_n")).where("_n <> ''")
    numbered = body.withColumn("_n", F.col("_n").cast("long"))
    last = numbered.agg(F.max("_n").alias("_last"))
    out = numbered.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("disc_id", F.when(F.col("_n") == F.col("_last"), F.lit(-1)).otherwise(F.col("_n"))).drop("_n", "_last")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0 in each file), value of every line of text files, read by any number of tasks.

    Lines are numbered within the blocks that Spark cuts a file into; a small table of the blocks' line counts shifts them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    # Written once: both passes must see the same blocks.
    lines = written(lines, "lines")
    blocks = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at")) - F.col("_n")  # one row for each block of a file
    shifted = blocks.select(F.col("file").alias("_f"), F.col("_at").alias("_a"), "_first", before.alias("_before"))
    both = lines.join(shifted, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_a")))
    return both.select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "value")


def read_spaced(spark: SparkSession, path: str, names: list[str], strict: bool = False) -> DataFrame:
    """White-space separated columns with line numbers by file; rows with too few or unreadable values are left out, or raise.

    Names must differ in more than case."""
    cut = numbered_lines(spark, path).select("line_no", F.split(F.trim("value"), r"\s+").alias("c"), "value").where("trim(value) <> ''")
    good = F.size("c") >= len(names)
    values = [F.when(good, F.get("c", F.lit(k)).try_cast("double")).alias(n) for k, n in enumerate(names)]
    out = cut.select("line_no", *values)
    bad = F.greatest(*(F.col(n).isNull().cast("int") for n in names)) == 1
    if strict and out.where(bad).limit(1).count():
        raise ValueError(f"{path} has unreadable rows")
    return out.where(~bad)


def valid_row_counts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """file_name and n_rows: lines of each file that are not blank, without its header."""
    lines = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), "value").where(F.trim("value") != "")
    return lines.groupBy("file_name").agg((F.count(F.lit(1)) - int(header)).alias("n_rows"))


#: Names of the canonical point table as Spark can tell them apart; files have A, B, C, D, RMS for the plane.
CANONICAL = {
    "X": "double", "Y": "double", "Z": "double", "nx": "double", "ny": "double", "nz": "double", "R": "int", "G": "int", "B": "int", "DR": "int", "DG": "int", "DB": "int",
    "Discontinuity_id": "int", "Cluster_id": "int", "Segment_id": "int", "A_plane": "double", "B_plane": "double", "C_plane": "double", "D_plane": "double",
    "RMS": "double", "Curvature": "double", "DistToPlane": "double",
}


def read_canonical(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The canonical point table from CSV with its fixed schema; only the columns asked for are parsed."""
    schema = ", ".join(f"`{c}` {k}" for c, k in CANONICAL.items())
    # The header names two columns B: it is left out by what it says, not matched by name.
    body = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).where("X IS NOT NULL")
    return body.select(*(columns or CANONICAL))


def by_alias(points: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """points with columns renamed to the first alias that is there, in any case; raises for a name without one."""
    have = {c.lower(): c for c in points.columns}
    for name, ways in aliases.items():
        found = next((have[w.lower()] for w in [name, *ways] if w.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}; known: {', '.join([name, *ways])}")
        points = points.withColumnRenamed(found, name)
    return points
