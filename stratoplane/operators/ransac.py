"""Plane search by random triples: every choice is an integer hash of a seed, so a query is a function of its data.

All candidates of a round are scored in one pass over the points, in numpy; what tasks count is summed after the shuffle.
"""

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planefit import plane_fit
from ..functions.vectors import dot, plane_through, vec
from ..shared_store import shared_folder, written

_MOD, _MUL, _ADD = 2147483647, 48271, 11
#: Distances of a matrix of points and candidates.
_CELLS = 1 << 16


def lcg(seed: int, n: int) -> list[int]:
    """n values of a fixed linear congruential generator."""
    out, x = [], seed % _MOD
    for _ in range(n):
        x = (x * _MUL + _ADD) % _MOD
        out.append(x)
    return out


def ordered_sample(points: DataFrame, seed: int, n: int) -> DataFrame:
    """The n points with the smallest hashes: a sample that does not depend on partitions."""
    h = F.pmod(F.pmod(F.col("point_id").cast("long"), F.lit(1000003)) * _MUL + F.lit(seed * 7919 % _MOD), F.lit(_MOD))
    return points.withColumn("_h", F.pmod(h * 69621 + 1, F.lit(_MOD))).orderBy("_h", "point_id").limit(n)


def candidate_planes(points: DataFrame, seed: int, n: int) -> DataFrame:
    """cand, a, b, c, d of n triples (collinear ones left out): three consecutive points of a hash-ordered sample each."""
    rows = [(r["point_id"], r["x"], r["y"], r["z"]) for r in ordered_sample(points, seed, 3 * n).select("point_id", "x", "y", "z").collect()]
    if len(rows) < 3:
        return points.sparkSession.createDataFrame([], "cand int, a double, b double, c double, d double")
    pick = lcg(seed, 3 * n)
    triples = [(k, *(float(v) for j in range(3) for v in rows[(pick[3 * k + j]) % len(rows)][1:])) for k in range(n)]
    names = [f"{p}{c}" for p in "pqr" for c in "xyz"]
    frame = points.sparkSession.createDataFrame(triples, "cand int, " + ", ".join(f"{c} double" for c in names))
    normal, d = plane_through(*(vec(*(f"{p}{c}" for c in "xyz")) for p in "pqr"))
    return frame.select("cand", *(v.alias(c) for v, c in zip(normal, "abc")), d.alias("d")).where("a IS NOT NULL")


def scores(points: DataFrame, candidates: DataFrame, threshold: float, sigma: float | None = None, weight: str | None = None) -> DataFrame:
    """cand, inliers (|distance| <= threshold) and, with sigma, the soft score sum(w exp(-d^2 / 2 sigma^2)).

    The candidates, as many as were asked for, go to the tasks as an array; a task hands over one row for each of them. Points
    and candidates meet in matrices that stay in a processor's cache, not as rows."""
    planes = candidates.select("cand", *"abcd").orderBy("cand").collect()  # as many rows as candidates asked for
    cand, plane = [r["cand"] for r in planes], np.array([[r[c] for c in "abcd"] for r in planes], float).reshape(-1, 4)
    kind = dict(candidates.dtypes)["cand"]

    def count(batches):
        inliers, score, any_row = np.zeros(len(cand), np.int64), np.zeros(len(cand)), False
        for batch in batches:
            x, y, z, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            any_row |= len(x) > 0
            step = max(1, _CELLS // max(1, len(x)))
            for k in range(0, len(cand), step):
                a, b, c, d = (plane[k : k + step, j, None] for j in range(4))
                dist = a * x
                dist += b * y
                dist += c * z
                dist += d
                np.abs(dist, out=dist)
                inliers[k : k + step] += np.count_nonzero(dist <= threshold, axis=1)
                if sigma:
                    score[k : k + step] += np.exp(dist * dist / (-2.0 * sigma * sigma)) @ w
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(cand, pa.int32() if kind == "int" else pa.int64()), pa.array(inliers), pa.array(score)], names=["cand", "inliers", "score"])

    own = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).dropna()
    parts = own.mapInArrow(count, f"cand {'int' if kind == 'int' else 'long'}, inliers long, score double") if cand else points.sparkSession.createDataFrame([], f"cand {kind}, inliers long, score double")
    return parts.groupBy("cand").agg(F.sum("inliers").alias("inliers"), *([F.sum("score").alias("score")] if sigma else []))


def best_plane(points: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """The candidate with most inliers (first wins), refitted to its inliers: one row with cand, inliers and the fit."""
    best = scores(points, candidates, threshold).orderBy(F.desc("inliers"), "cand").limit(1).join(candidates, "cand").select("cand", *(F.col(c).alias(f"_{c}") for c in "abcd"))
    near = points.crossJoin(F.broadcast(best)).where(F.abs(dot(vec("_a", "_b", "_c"), vec("x", "y", "z")) + F.col("_d")) <= threshold)  # one row
    return plane_fit(near, ["cand"])


def detect_planes(points: DataFrame, threshold: float, least: int, tries: int, most: int | None = None, seed: int = 1, weight: str | None = None, sigma: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Plane after plane: the best candidate's inliers leave, until fewer than ``least`` points remain or the best candidate has
    fewer inliers. ``most`` ends the search early.

    Returns planes (plane_id, fit) and members (plane_id, point_id). Each plane's points and the remaining ones are written, so
    plans stay short however many planes there are."""
    spark, rest, k = points.sparkSession, points, 0
    folder = f"{shared_folder(spark)}/ransac-planes-{uuid.uuid4().hex}"
    none = points.limit(0).withColumn("plane_id", F.lit(0))
    none.write.parquet(folder)
    while (most is None or k < most) and rest.limit(least).count() >= least:
        found = written(candidate_planes(rest, seed + k, tries), "candidates")
        scored = scores(rest, found, threshold, sigma, weight)
        if sigma:
            scored = scored.where(F.col("inliers") >= least)
        key = F.desc("score") if sigma else F.desc("inliers")
        top = scored.orderBy(key, "cand").limit(1).join(found, "cand").first()
        if top is None or top["inliers"] < least:
            break
        n = (F.lit(top["a"]), F.lit(top["b"]), F.lit(top["c"]))
        on = F.abs(dot(n, vec("x", "y", "z")) + F.lit(top["d"])) <= threshold
        marked = written(rest.withColumn("_on", on), "ransac")
        marked.where("_on").drop("_on").withColumn("plane_id", F.lit(k)).write.mode("append").parquet(folder)
        rest, k = marked.where("NOT _on").drop("_on"), k + 1
    inliers = spark.read.schema(none.schema).parquet(folder)
    return plane_fit(inliers, ["plane_id"], weight), inliers.select("plane_id", "point_id")


def _fit_numpy(xyz: np.ndarray) -> tuple[np.ndarray, float]:
    centre = xyz.mean(axis=0)
    normal = np.linalg.eigh(np.cov((xyz - centre).T, bias=True))[1][:, 0]
    return normal, float(-normal @ centre)


def ransac_numpy(xyz: np.ndarray, threshold: float, tries: int, seed: int, block: int = 64) -> np.ndarray:
    """Inlier mask of the best of ``tries`` seeded triples; candidates are scored in blocks of bounded memory."""
    n = len(xyz)
    best, count = np.zeros(n, bool), 0
    if n < 3:
        return best
    pick = np.random.default_rng(seed).integers(0, n, (tries, 3))
    p, q, r = (xyz[pick[:, k]] for k in range(3))
    normal = np.cross(q - p, r - p)
    size = np.linalg.norm(normal, axis=1)
    ok = size > 1e-8
    normal, p = normal[ok] / size[ok, None], p[ok]
    for lo in range(0, len(normal), block):
        near = np.abs((xyz @ normal[lo : lo + block].T) - (p[lo : lo + block] * normal[lo : lo + block]).sum(axis=1)) <= threshold
        sums = near.sum(axis=0)
        k = int(sums.argmax()) if len(sums) else 0
        if len(sums) and sums[k] > count:
            best, count = near[:, k], int(sums[k])
    return best


def _largest_cells(uv: np.ndarray, cell: float, by_points: bool, eight: bool) -> np.ndarray:
    """Mask of the points in the largest connected component of occupied grid cells."""
    key = np.floor((uv - uv.min(axis=0)) / cell).astype(np.int64)
    cells, place, counts = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    place = place.ravel()
    number = {tuple(c): k for k, c in enumerate(cells.tolist())}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    label = np.full(len(cells), -1)
    for start in range(len(cells)):
        if label[start] >= 0:
            continue
        label[start], todo = start, [start]
        while todo:
            i, j = cells[todo.pop()]
            for di, dj in steps:
                k = number.get((i + di, j + dj))
                if k is not None and label[k] < 0:
                    label[k] = start
                    todo.append(k)
    sums = np.bincount(label, counts if by_points else None, minlength=len(cells))
    return label[place] == int(sums.argmax())


def axes_numpy(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ref = np.array([0.0, 1.0, 0.0]) if abs(n[2]) > 0.9 else np.array([0.0, 0.0, 1.0])
    u = np.cross(ref, n)
    u /= np.linalg.norm(u)
    return u, np.cross(n, u)


def voxel_patches(keyed: DataFrame, threshold: float, least: int, tries: int = 200, seed: int = 1, rounds: int = 1, thickness: float | None = None, cell: float | None = None, angle: float | None = None, eight: bool = True, by_points: bool = True, start: int = 0) -> DataFrame:
    """point_id, voxel and patch (0, 1, ... in its voxel; -1: none) of a seeded plane search in every voxel.

    With thickness the patch is the band of all the voxel's points around the plane; with angle (degrees) normals must agree;
    with cell only the largest connected component of occupied cells in the plane stays. No search begins on fewer than
    ``start`` points that are left. A voxel's points are one
    group: its size bounds them."""
    kinds = dict(keyed.dtypes)
    normals = all(c in kinds for c in ("nx", "ny", "nz")) and angle is not None

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        patch = np.full(len(pdf), -1)
        key = zlib.crc32(repr((seed, *(int(pdf[c].iat[0]) for c in ("vx", "vy", "vz")))).encode())
        for k in range(rounds):
            at = np.flatnonzero(patch < 0)
            if len(at) < max(start, least):
                break
            on = ransac_numpy(xyz[at], threshold, tries, key + k)
            if on.sum() < max(3, least):
                break
            n, d = _fit_numpy(xyz[at[on]])
            if thickness is not None:
                on = np.abs(xyz[at] @ n + d) <= thickness
            if normals:
                own = pdf[["nx", "ny", "nz"]].to_numpy(float)[at]
                on &= np.abs(own @ n) >= np.cos(np.radians(angle))
            if cell is not None and on.any():
                uv = xyz[at[on]] @ np.array(axes_numpy(n)).T
                on[np.flatnonzero(on)] = _largest_cells(uv, cell, by_points, eight)
            if on.sum() < least:
                break
            patch[at[on]] = k
        return pd.DataFrame({"point_id": pdf["point_id"], "vx": pdf["vx"], "vy": pdf["vy"], "vz": pdf["vz"], "patch": patch})

    cols = ["point_id", "vx", "vy", "vz", "x", "y", "z"] + (["nx", "ny", "nz"] if normals else [])
    return keyed.select(*cols).groupBy("vx", "vy", "vz").applyInPandas(search, "point_id long, vx long, vy long, vz long, patch long")
