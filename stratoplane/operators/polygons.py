"""Polygons of planar patches: convex hulls in the plane, and area, diameter, widths and triangle fans of ordered rings."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planefit import plane_fit
from ..functions.vectors import dot, in_plane_axes, minus, vec
from ..shared_store import written


def plane_coordinates(points: DataFrame, key: str, fits: DataFrame) -> DataFrame:
    """points with u, v in their key's plane (about the centroid) and their foot points px, py, pz."""
    f = fits.select(key, *(F.col(c).alias(f"_{c}") for c in ("a", "b", "c", "d", "cx", "cy", "cz")))
    p = points.join(f, key)
    n, c = vec("_a", "_b", "_c"), vec("_cx", "_cy", "_cz")
    u, v = in_plane_axes(n)
    off = minus(vec("x", "y", "z"), c)
    h = dot(n, vec("x", "y", "z")) + F.col("_d")
    p = p.withColumns({"u": dot(u, off), "v": dot(v, off), **{f"p{k}": F.col(k) - h * F.col(f"_{a}") for k, a in zip("xyz", "abc")}})
    return p.drop(*(f"_{c}" for c in ("a", "b", "c", "d", "cx", "cy", "cz")))


def hull_numpy(uv: np.ndarray) -> np.ndarray:
    """Places of the convex hull's corners, counter-clockwise (monotone chain)."""
    order = np.lexsort((uv[:, 1], uv[:, 0]))
    keep = np.ones(len(order), bool)
    keep[1:] = (uv[order[1:]] != uv[order[:-1]]).any(axis=1)
    order = order[keep]
    if len(order) < 3:
        return order

    def half(places):
        out = []
        for i in places:
            while len(out) >= 2:
                (ax, ay), (bx, by) = uv[out[-2]], uv[out[-1]]
                if (bx - ax) * (uv[i][1] - ay) - (by - ay) * (uv[i][0] - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    low, high = half(order.tolist()), half(order[::-1].tolist())
    return np.array(low[:-1] + high[:-1])


def hulls(flat: DataFrame, key: str, directions: int = 64) -> DataFrame:
    """key, k (0, 1, ... counter-clockwise), u, v and px, py, pz of the corners of each key's convex hull.

    First each partition's corners are found for itself, so a key's group is its partitions' corners, not its points."""
    kind = dict(flat.dtypes)[key]
    names = ["u", "v", "px", "py", "pz"]

    def local(frames):
        for pdf in frames:
            for _, part in pdf.groupby(key, sort=False, dropna=False):
                yield part.iloc[hull_numpy(part[["u", "v"]].to_numpy(float))]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ignore_index=True)
        out = pdf.iloc[hull_numpy(pdf[["u", "v"]].to_numpy(float))].reset_index(drop=True)
        return out.assign(k=np.arange(len(out)))[[key, "k", *names]]

    some = flat.select(key, *names).mapInPandas(local, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names))
    return some.groupBy(key).applyInPandas(final, f"`{key}` {kind}, k long, " + ", ".join(f"{c} double" for c in names))


def _ring(key: str) -> tuple[Window, Window]:
    w = Window.partitionBy(key).orderBy("k")
    return w, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def edges(corners: DataFrame, key: str) -> DataFrame:
    """corners with the next corner of the ring (u2, v2); the last one's next is the first."""
    w, whole = _ring(key)
    return corners.withColumns({f"{c}2": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("u", "v")})


def areas(corners: DataFrame, key: str) -> DataFrame:
    """key, corners and the area inside each ring (shoelace; 0 below three corners)."""
    e = edges(corners, key)
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("corners"), (F.abs(F.sum(F.col("u") * F.col("v2") - F.col("u2") * F.col("v"))) / 2.0).alias("area"))


def diameters(corners: DataFrame, key: str) -> DataFrame:
    """key, trace: the largest distance of two corners, and the pair (lowest numbers first)."""
    a = corners.select(key, F.col("k").alias("i"), F.col("u").alias("ua"), F.col("v").alias("va"))
    b = corners.select(key, F.col("k").alias("j"), F.col("u").alias("ub"), F.col("v").alias("vb"))
    d = F.sqrt((F.col("ua") - F.col("ub")) * (F.col("ua") - F.col("ub")) + (F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb")))
    both = a.join(b, key).where("i < j").withColumn("d", d)
    best = both.groupBy(key).agg(F.max_by(F.struct("i", "j", "d", "ua", "va", "ub", "vb"), F.struct("d", -F.col("i"), -F.col("j"))).alias("m"))
    return best.select(key, F.col("m.d").alias("trace"), F.col("m.i").alias("i"), F.col("m.j").alias("j"), *(F.col(f"m.{c}").alias(c) for c in ("ua", "va", "ub", "vb")))


def sample_lines(trace: Column, area: Column, n: Column) -> Column:
    """How many lines a polygon's width is measured at: its trace over the point spacing, from 3 to 200."""
    return F.greatest(F.lit(3), F.least(F.lit(200), F.floor(trace / F.nullif(F.sqrt(area / n), F.lit(0.0))).cast("int")))


def widths(corners: DataFrame, key: str, lines: DataFrame) -> DataFrame:
    """key, line, width: the polygon's extent across its trace at evenly spaced places; lines has key and how many.

    A line crosses an edge where 0 <= t <= 1; the width is the distance of the outermost crossings."""
    axis = diameters(corners, key).join(lines, key).withColumn("line", F.explode(F.sequence(F.lit(1), F.col("lines"))))
    s = F.col("line") / (F.col("lines") + 1.0)
    dx, dy = (F.col("ub") - F.col("ua")) / F.col("trace"), (F.col("vb") - F.col("va")) / F.col("trace")
    axis = axis.where("trace > 0").select(key, "line", dx.alias("dx"), dy.alias("dy"), (F.col("ua") + s * (F.col("ub") - F.col("ua"))).alias("x0"), (F.col("va") + s * (F.col("vb") - F.col("va"))).alias("y0"))
    e = edges(corners, key).select(key, "u", "v", "u2", "v2")
    both = axis.join(e, key)
    # Places along the trace direction of both ends, relative to the line.
    along = lambda u, v: (F.col(u) - F.col("x0")) * F.col("dx") + (F.col(v) - F.col("y0")) * F.col("dy")
    across = lambda u, v: -(F.col(u) - F.col("x0")) * F.col("dy") + (F.col(v) - F.col("y0")) * F.col("dx")
    both = both.withColumns({"s1": along("u", "v"), "s2": along("u2", "v2"), "c1": across("u", "v"), "c2": across("u2", "v2")})
    t = F.col("s1") / F.nullif(F.col("s1") - F.col("s2"), F.lit(0.0))
    cut = both.withColumn("t", t).where("t BETWEEN 0 AND 1").withColumn("c", F.col("c1") + F.col("t") * (F.col("c2") - F.col("c1")))
    return cut.groupBy(key, "line").agg((F.max("c") - F.min("c")).alias("width"))


def triangle_fan(corners: DataFrame, key: str) -> DataFrame:
    """key, k and the triangle (corner k, next corner, centroid) of each ring: vertex numbers; the centroid is number 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return corners.select(key, "k", F.lit(0).cast("long").alias("v0"), (F.col("k") + 1).alias("v1"), (F.pmod(F.col("k") + 1, n) + 1).alias("v2"))


def largest_cells(cells: np.ndarray) -> np.ndarray:
    """Of distinct grid cells (rows i, j) those of the largest part that touches by sides or corners; ties to the part met first."""
    place = {tuple(c): n for n, c in enumerate(cells.tolist())}
    part, best, size = np.full(len(cells), -1), -1, 0
    for n in range(len(cells)):
        if part[n] >= 0:
            continue
        part[n], todo, count = n, [n], 0
        while todo:
            i, j = cells[todo.pop()].tolist()
            count += 1
            for near in ((i + di, j + dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)):
                m = place.get(near)
                if m is not None and part[m] < 0:
                    part[m] = n
                    todo.append(m)
        if count > size:
            best, size = n, count
    return cells[part == best]


def hull_filter(points: DataFrame, key: str, fits: DataFrame, cell: float) -> DataFrame:
    """The points of each key that lie inside the convex hull of its plane's largest connected part of grid cells, as (key, point_id).

    A key's group are its occupied cells, not its points; the hull goes back to the points as an array. Keys without three cells
    apart keep the cells' own points."""
    kind = dict(points.dtypes)[key]

    def shape(rows: pa.Table) -> pa.Table:
        cells = np.unique(np.stack([rows.column(c).to_numpy() for c in ("ci", "cj")], axis=1), axis=0)
        main = largest_cells(cells)
        centres = (main + 0.5) * cell
        corners = centres[hull_numpy(centres)]
        sides, own = [], []
        if len(corners) < 3:
            own = [{"ci": i, "cj": j} for i, j in main.tolist()]
        else:
            step = np.roll(corners, -1, axis=0) - corners
            sides = [dict(zip(("u", "v", "du", "dv"), x)) for x in np.column_stack([corners, step]).tolist()]
        return pa.table({key: rows.column(key).slice(0, 1), "sides": pa.array([sides], pa.list_(pa.struct([(c, pa.float64()) for c in ("u", "v", "du", "dv")]))), "cells": pa.array([own], pa.list_(pa.struct([(c, pa.int64()) for c in ("ci", "cj")])))})

    flat = plane_coordinates(points, key, fits).select(key, "point_id", "u", "v")
    flat = flat.withColumns({c: F.floor(F.col(x) / F.lit(cell)).cast("long") for c, x in (("ci", "u"), ("cj", "v"))})
    shapes = flat.select(key, "ci", "cj").distinct().groupBy(key).applyInArrow(shape, f"`{key}` {kind}, sides array<struct<u: double, v: double, du: double, dv: double>>, cells array<struct<ci: long, cj: long>>")
    inside = F.forall("sides", lambda s: s["du"] * (F.col("v") - s["v"]) - s["dv"] * (F.col("u") - s["u"]) >= -1e-12)
    own = F.exists("cells", lambda c: (c["ci"] == F.col("ci")) & (c["cj"] == F.col("cj")))
    return flat.join(written(shapes, "hull-shapes"), key).where(F.when(F.size("sides") > 0, inside).otherwise(own)).select(key, "point_id")


def patch_geometry(points: DataFrame, key: str) -> DataFrame:
    """key, points, area, trace and mean width of each key's points: fit, hull and its measures."""
    fits = plane_fit(points, [key]).where("a IS NOT NULL")
    corners = hulls(plane_coordinates(points, key, fits), key)
    measure = areas(corners, key).join(diameters(corners, key).select(key, "trace"), key).join(fits.select(key, "n", "rmse"), key)
    many = measure.where("area > 0").select(key, sample_lines(F.col("trace"), F.col("area"), F.col("n")).alias("lines"))
    width = widths(corners, key, many).groupBy(key).agg(F.avg("width").alias("mean_width"))
    return measure.join(width, key, "left").select(key, F.col("n").alias("points"), "rmse", "area", "trace", "mean_width")
