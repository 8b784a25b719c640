"""Voxel patches: growing seeds from remaining points, merging edge patches and patches, and their diagnostics.

A patch assignment is a column, never a hidden set: ``seed`` is NULL for remaining points. Steps that are greedy in nature
(merging patches by error) work on patch rows, whose number is bounded by the occupied voxels.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planefit import plane_fit
from ..functions.vectors import dot, in_plane_axes, minus, plane_angle, vec
from ..shared_store import written
from .graph import components
from .voxels import KEY

PLANE = ("a", "b", "c")


def least_squares_patches(keyed: DataFrame, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """One plane per voxel with at least ``least`` points: seeds (voxel, fit, inliers) and points with on_plane.

    The inliers are the points within threshold of the least-squares plane; a voxel with too few of them gives no seed."""
    fits = plane_fit(keyed, KEY).where((F.col("n") >= least) & F.col("a").isNotNull())
    p = keyed.join(fits.select(*KEY, *PLANE, "d"), KEY, "left")
    near = F.coalesce(F.abs(dot(vec(*PLANE), vec("x", "y", "z")) + F.col("d")) <= threshold, F.lit(False))
    p = p.withColumn("near", near)
    counts = p.groupBy(*KEY).agg(F.count_if("near").alias("inliers"))
    seeds = fits.join(counts, KEY).where(F.col("inliers") >= least)
    p = p.drop(*PLANE, "d").join(seeds.select(*KEY, F.lit(True).alias("_seed")), KEY, "left")
    return seeds, p.withColumn("on_plane", F.col("near") & F.coalesce("_seed", F.lit(False))).drop("near", "_seed")


def patch_adjacency(members: DataFrame, patch: str = "patch") -> DataFrame:
    """Pairs p < q of patches that share a voxel or lie in voxels that touch; members has patch and voxel columns."""
    cells = members.select(patch, *KEY).distinct()
    near = cells.select(F.col(patch).alias("p"), *KEY)
    for c in KEY:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return near.hint("merge").join(cells.select(F.col(patch).alias("q"), *KEY), KEY).where("p < q").select("p", "q").distinct()


def edge_matches(edge: DataFrame, seeds: DataFrame, points: DataFrame, most_distance: float, most_angle: float, ident: tuple[str, ...] = ()) -> DataFrame:
    """For each edge patch (voxel, fit) the neighbouring voxels' seed that takes it, or the reason why none does.

    mw is the mean distance of the edge patch's points from the seed's plane, nw the angle of the planes; among seeds below both
    limits the smallest mw / limit + nw / limit wins, ties to the smaller voxel. A patch's own voxel is not searched.
    points has the edge patch's points with its voxel; ``ident`` tells several edge patches of a voxel apart in both."""
    own = [*KEY, *ident]
    around = edge.select(*own, *(F.col(c).alias(f"e{c}") for c in PLANE))
    for c in KEY:
        around = around.withColumn(f"n{c[1]}", F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    around = around.where("NOT (nx = vx AND ny = vy AND nz = vz)")
    s = seeds.select(*(F.col(c).alias(f"n{c[1]}") for c in KEY), *(F.col(c).alias(f"s{c}") for c in (*PLANE, "d")))
    cand = around.hint("merge").join(s, ["nx", "ny", "nz"])
    both = cand.join(points.select(*own, "x", "y", "z"), own)
    dist = F.abs(dot(vec("sa", "sb", "sc"), vec("x", "y", "z")) + F.col("sd"))
    nw = plane_angle(vec("ea", "eb", "ec"), vec("sa", "sb", "sc"))
    rated = both.groupBy(*own, "nx", "ny", "nz").agg(F.avg(dist).alias("mw"), F.first(nw).alias("nw"))
    ok_d, ok_a = F.col("mw") < most_distance, F.col("nw") < most_angle
    rated = rated.withColumns({"ok": ok_d & ok_a, "ok_d": ok_d, "ok_a": ok_a, "pw": F.col("mw") / most_distance + F.col("nw") / most_angle})
    best = rated.groupBy(*own).agg(
        F.min_by(F.struct("nx", "ny", "nz", "mw", "nw", "pw"), F.when(F.col("ok"), F.struct("pw", "nx", "ny", "nz"))).alias("m"),
        F.bool_or("ok").alias("any"), F.bool_or("ok_d").alias("any_d"), F.bool_or("ok_a").alias("any_a"),
    )
    out = edge.select(*own).join(best, own, "left")
    reason = (
        F.when(F.col("any").isNull(), "no_neighbor_cluster").when(F.col("any"), "merged")
        .when(~F.col("any_d") & ~F.col("any_a"), "blocked_by_distance_and_angle").when(~F.col("any_d"), "blocked_by_edge_distance")
        .when(~F.col("any_a"), "blocked_by_edge_angle").otherwise("blocked_unknown")
    )
    return out.select(*own, reason.alias("merge_reason"), *(F.when(F.col("any"), F.col(f"m.{c}")).alias(c) for c in ("nx", "ny", "nz", "mw", "nw", "pw")))


def growth_levels(distance: float, angle: float, step_distance: float, step_angle: float) -> list[tuple[int, float, float]]:
    """The thresholds that a growth step tries in turn, both lowered until both are 0."""
    out, k = [], 0
    while True:
        d, a = max(0.0, distance - k * step_distance), max(0.0, angle - k * step_angle)
        out.append((k, d, a))
        if d <= 0 and a <= 0:
            return out
        k += 1


def grow_seeds(seeds: DataFrame, free: DataFrame, members: DataFrame, levels: list[tuple[int, float, float]], most_turn: float) -> DataFrame:
    """point_id, seed: remaining points that seeds take from their own and the touching voxels.

    Every level of thresholds is evaluated at once: a seed's points at a level, refitted together with its members; the first
    level whose plane turns at most most_turn degrees counts. A point that several seeds take goes to the smallest.
    seeds: seed, voxel, a, b, c, d; free: point_id, voxel, x, y, z, nx, ny, nz; members: seed, x, y, z."""
    spark = seeds.sparkSession
    around = seeds.select("seed", *KEY, *PLANE, "d")
    for c in KEY:
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    cand = around.hint("merge").join(free, KEY)
    dist = F.abs(dot(vec(*PLANE), vec("x", "y", "z")) + F.col("d"))
    cosine = F.abs(dot(vec(*PLANE), vec("nx", "ny", "nz")))
    level = spark.createDataFrame(levels, "level int, td double, ta double")
    taken = cand.withColumns({"dist": dist, "cosine": cosine}).crossJoin(F.broadcast(level)).where((F.col("dist") < F.col("td")) & (F.col("cosine") >= F.cos(F.radians("ta"))))  # some thirty rows
    taken = written(taken.select("seed", "level", "point_id", "x", "y", "z"), "growth")
    tried = taken.select("seed", "level").distinct()
    every = taken.select("seed", "level", "x", "y", "z").unionByName(members.join(tried, "seed").select("seed", "level", "x", "y", "z"))
    fits = plane_fit(every, ["seed", "level"]).select("seed", "level", *(F.col(c).alias(f"r{c}") for c in PLANE))
    turned = fits.join(seeds.select("seed", *PLANE), "seed").where(plane_angle(vec(*PLANE), vec("ra", "rb", "rc")) <= most_turn)
    first = turned.groupBy("seed").agg(F.min("level").alias("level"))
    return taken.join(first, ["seed", "level"]).groupBy("point_id").agg(F.min("seed").alias("seed"))


def mergeable(patches: DataFrame, adjacency: DataFrame, most_angle: float, most_distance: float, voxel: float) -> DataFrame:
    """The adjacent pairs with the measures and the decision of a patch merge.

    patches: patch, a, b, c, d, cx, cy, cz. A pair merges if its angle, the distance of one centroid from the other's plane and the
    centroids' distance stay below their limits."""
    side = lambda n: patches.select(F.col("patch").alias(n), *(F.col(c).alias(f"{n}{c}") for c in (*PLANE, "d", "cx", "cy", "cz")))
    e = adjacency.join(side("p"), "p").join(side("q"), "q")
    angle = plane_angle(vec("pa", "pb", "pc"), vec("qa", "qb", "qc"))
    dist = F.abs(dot(vec("pa", "pb", "pc"), vec("qcx", "qcy", "qcz")) + F.col("pd"))
    gap = F.sqrt(sum(((F.col(f"pc{c}") - F.col(f"qc{c}")) * (F.col(f"pc{c}") - F.col(f"qc{c}")) for c in "xyz"), F.lit(0.0)))
    e = e.withColumns({"ang_diff": angle, "dist_diff": dist, "centroid_diff": gap})
    far = max(3.0 * voxel, 2.0 * most_distance)
    e = e.withColumns({"pass_angle": F.col("ang_diff") < most_angle, "pass_distance": F.col("dist_diff") < most_distance, "pass_centroid": F.col("centroid_diff") < far})
    return e.select("p", "q", "ang_diff", "dist_diff", "centroid_diff", "pass_angle", "pass_distance", "pass_centroid", (F.col("pass_angle") & F.col("pass_distance") & F.col("pass_centroid")).alias("merge"))


def merge_patches(patches: DataFrame, adjacency: DataFrame, most_angle: float, most_distance: float, voxel: float) -> DataFrame:
    """patch, disc: patches joined over mergeable pairs, without an order (components of the pairs that pass)."""
    pairs = mergeable(patches, adjacency, most_angle, most_distance, voxel).where("merge")
    found = components(pairs, "p", "q").select(F.col("node").alias("patch"), F.col("component").alias("disc"))
    return patches.select("patch").join(found, "patch", "left").select("patch", F.coalesce("disc", "patch").alias("disc"))


def greedy_merge(rows: list[dict], pairs: list[tuple[int, int]], most_angle: float, most_distance: float, voxel: float) -> dict[int, int]:
    """patch -> seed patch, best error first, the plane refitted from pooled moments after each merge (the ordered variant).

    rows have patch, error, n, c (centroid) and m (3 x 3 centred second moments). For the driver, on a bounded number of patches."""
    info = {r["patch"]: r for r in rows}
    near: dict[int, set[int]] = {r["patch"]: set() for r in rows}
    for p, q in pairs:
        near[p].add(q)
        near[q].add(p)
    owner: dict[int, int] = {}
    far = max(3.0 * voxel, 2.0 * most_distance)
    for seed in sorted(info, key=lambda k: (info[k]["error"], k)):
        if seed in owner:
            continue
        owner[seed] = seed
        n, c, m = info[seed]["n"], np.array(info[seed]["c"], float), np.array(info[seed]["m"], float)
        queue = sorted(near[seed], key=lambda k: (info[k]["error"], k))
        while queue:
            k = queue.pop(0)
            if k in owner:
                continue
            normal = np.linalg.eigh(m)[1][:, 0]
            other = info[k]
            side = np.linalg.eigh(np.array(other["m"], float))[1][:, 0]
            oc = np.array(other["c"], float)
            angle = np.degrees(np.arccos(min(1.0, abs(float(normal @ side)))))
            if angle < most_angle and abs(float(normal @ (oc - c))) < most_distance and np.linalg.norm(oc - c) < far:
                owner[k] = seed
                total = n + other["n"]
                centre = (c * n + oc * other["n"]) / total
                m = (n * (m + np.outer(c - centre, c - centre)) + other["n"] * (np.array(other["m"], float) + np.outer(oc - centre, oc - centre))) / total
                n, c = total, centre
                queue = sorted({*queue, *(x for x in near[k] if x not in owner)}, key=lambda x: (info[x]["error"], x))
    return owner


def band_cells(points: DataFrame, fits: DataFrame, thickness: float, cell: float, least_cosine: float | None = None) -> DataFrame:
    """Points within thickness of their voxel's plane (normals agreeing, if asked) with the integer cell (ci, cj) of their place in it."""

    f = fits.select(*KEY, *(F.col(c).alias(f"_{c}") for c in (*PLANE, "d", "cx", "cy", "cz")))
    p = points.join(f, KEY).where(F.abs(dot(vec("_a", "_b", "_c"), vec("x", "y", "z")) + F.col("_d")) <= thickness)
    if least_cosine is not None:
        p = p.where(F.abs(dot(vec("_a", "_b", "_c"), vec("nx", "ny", "nz"))) >= least_cosine)
    u, v = in_plane_axes(vec("_a", "_b", "_c"))
    off = minus(vec("x", "y", "z"), vec("_cx", "_cy", "_cz"))
    return p.withColumns({"ci": F.floor(dot(u, off) / cell).cast("long"), "cj": F.floor(dot(v, off) / cell).cast("long")}).drop(*(f"_{c}" for c in ("a", "b", "c", "d", "cx", "cy", "cz")))


def cell_components(cells: DataFrame, keys: list[str], eight: bool = True) -> DataFrame:
    """Occupied cells (keys, ci, cj, n points) with the component each belongs to (named by its smallest cell number).

    Cells are numbered by a 64-bit hash of keys and place; edges are an equi-join with the cells around."""
    c = cells.groupBy(*keys, "ci", "cj").agg(F.count(F.lit(1)).alias("n"))
    ident = lambda i, j: F.xxhash64(*keys, i, j)
    c = c.withColumn("cell", ident(F.col("ci"), F.col("cj")))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    side = c.select("cell", *keys, "ci", "cj").withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))))
    there = side.select(F.col("cell").alias("a"), *keys, (F.col("ci") + F.col("_s.i")).alias("ci"), (F.col("cj") + F.col("_s.j")).alias("cj"))
    edges = there.join(c.select(F.col("cell").alias("b"), *keys, "ci", "cj"), [*keys, "ci", "cj"]).select("a", "b")
    found = components(edges, "a", "b").select(F.col("node").alias("cell"), "component")
    return c.join(found, "cell", "left").withColumn("component", F.coalesce("component", "cell")).select(*keys, "ci", "cj", "n", "component")


def largest_component(labelled: DataFrame, keys: list[str], by_points: bool = True) -> DataFrame:
    """The cells of each key's largest component, by points or by cells; ties to the one with the smallest cell."""
    size = F.sum("n") if by_points else F.count(F.lit(1))
    sums = labelled.groupBy(*keys, "component").agg(size.alias("size"), F.min(F.struct("ci", "cj")).alias("low"))
    best = sums.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("size"), "low")).alias("component"), F.max("size").alias("size"))
    return labelled.join(best, [*keys, "component"]).select(*keys, "ci", "cj", "n", "size")


def oriented(fits: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """fits with normals turned to the side of their points' mean normal (key, nx, ny, nz in points)."""
    mean = points.groupBy(key).agg(*(F.avg(c).alias(f"_{c}") for c in ("nx", "ny", "nz")))
    f = fits.join(mean, key, "left")
    sign = F.when(dot(vec(*PLANE), vec("_nx", "_ny", "_nz")) < 0, -1.0).otherwise(1.0)
    return f.withColumns({c: F.col(c) * sign for c in (*PLANE, "d")}).drop("_nx", "_ny", "_nz")


def united(parts: list[DataFrame], key: str, member: str) -> DataFrame:
    """The members of all parts by key, each once, as a sorted array."""
    every = parts[0].select(key, member)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, member))
    return every.distinct().groupBy(key).agg(F.sort_array(F.collect_list(member)).alias(member))
