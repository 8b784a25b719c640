"""Conversions of foreign tables to the canonical ones: set exports, facet exports, validation of labelled clouds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import id_colour
from ..operators.orientation_clusters import ranked


def as_integer(text: Column) -> Column:
    """'3.0' or '3' as 3; NULL where it is no number."""
    return text.try_cast("double").cast("bigint")


def base_name(path: Column) -> Column:
    """A path's last part without its suffix; a leading dot begins no suffix."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(.)\.[^.]*$", "$1")


def seeded_colours(rows: DataFrame, ident: str, low: int = 0, high: int = 256, shift: int = 12345) -> DataFrame:
    """rows with dr, dg, db drawn by numpy's default generator seeded with the id plus ``shift``: the same for an id everywhere."""
    ids = rows.select(F.col(ident).cast("long").alias(ident)).where(F.col(ident).isNotNull()).distinct()

    def draw(batches):
        for b in batches:
            found = np.array([np.random.default_rng(k + shift).integers(low, high, size=3) for k in b.column(0).to_pylist()], np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k]) for k in range(3))], names=[ident, "dr", "dg", "db"])

    return rows.join(ids.mapInArrow(draw, f"`{ident}` long, dr int, dg int, db int"), ident, "left")


def set_points(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Rows (X, Y, Z, js, cl, A, B, C, D, line number) with disc_id, dense by the first line of each (js, cl), and its colour."""
    keyed = rows.withColumns({"js": F.col("js").cast("bigint"), "cl": F.col("cl").cast("bigint")})
    first = ranked(keyed.groupBy("js", "cl").agg(F.min(order).alias("_first")), [F.col("_first")], "_first", "disc_id").select("js", "cl", "disc_id")
    red, green, blue = id_colour(F.col("disc_id"))
    return keyed.join(first, ["js", "cl"]).withColumns({"DR": red, "DG": green, "DB": blue})


def facet_tables(points: DataFrame, labels: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """points (facet_id) with cluster_id (missing: -1), the facet's number within its cluster and, with metrics, its plane."""
    cluster = labels.select("facet_id", F.col("cluster_id").cast("bigint").alias("cluster_id")).dropDuplicates(["facet_id"])
    out = points.join(cluster, "facet_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")))
    pairs = out.select("cluster_id", "facet_id").distinct()
    pairs = pairs.withColumn("sub_id", F.row_number().over(Window.partitionBy("cluster_id").orderBy("facet_id")))
    out = out.join(pairs, ["cluster_id", "facet_id"], "left")
    return out.join(metrics.select("facet_id", "A", "B", "C", "D"), "facet_id", "left") if metrics is not None else out


def range_profile(points: DataFrame, needed: list[str]) -> DataFrame:
    """One row: rows, smallest and largest value and missing values of each needed column; raises if one is not there."""
    missing = [c for c in needed if c.lower() not in {x.lower() for x in points.columns}]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    out = [F.count(F.lit(1)).alias("n")]
    for c in needed:
        out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"missing_{c}")]
    return points.agg(*out)


def painted(points: DataFrame, ident: str, sets: list[DataFrame], colours: list[tuple[int, int, int]], default: int = 160) -> DataFrame:
    """points with r, g, b of the last set that holds them; others grey."""
    out = points
    for k, s in enumerate(sets):
        out = out.join(s.select(F.col(ident), F.lit(True).alias(f"_in{k}")).distinct(), ident, "left")
    for c, name in enumerate("rgb"):
        ways = [F.when(F.col(f"_in{k}"), F.lit(colours[k][c])) for k in reversed(range(len(sets)))]
        out = out.withColumn(name, F.coalesce(*ways, F.lit(default)))
    return out.drop(*(f"_in{k}" for k in range(len(sets))))
