"""Queries on points, voxels, planes and neighbourhoods."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.planefit import plane_fit
from ..operators import blocks, hemisphere, neighbours, patches, polygons, ransac, voxels
from ..operators.statistics import curvature_weights
from ..operators.voxels import KEY
from ..shared_store import written
from .fixtures import LEAST, PTS, SIZE, dip_sql, dir_sql, fit_sql, pts, q6, r6, vox, vox_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q9(text: str) -> str:
    """Nine places, where values with few decimals are averaged and six would often be halves."""
    return f"(round({text}, 9) + 0.0)"


@query(f"WITH {PTS} SELECT count(*) AS n, {', '.join(f'{q6(f'{f}({c})')} AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} FROM pts")
def aabb(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.bounds(pts(spark, sf)).select("n", *(r6(f"{f}_{c}").alias(f"{f}_{c}") for c in "xyz" for f in ("min", "max")))


@query(f"""WITH {PTS}, {vox_sql()} SELECT vx, vy, vz, count(*) AS num_points, {', '.join(f'{q6(f'{f}({c})')} AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))},
 'voxel_' || vx || '_' || vy || '_' || vz AS file_name FROM vox GROUP BY vx, vy, vz HAVING count(*) >= {LEAST}""")
def voxel_index(spark, sf):
    i = voxels.voxel_index(vox(spark, sf), LEAST)
    return i.select(*KEY, "num_points", *(r6(f"{f}_{c}").alias(f"{f}_{c}") for c in "xyz" for f in ("min", "max")), "file_name")


@query(f"""WITH {PTS}, {vox_sql()}, o AS (SELECT count(*) AS n FROM vox GROUP BY vx, vy, vz)
 SELECT count(*) AS voxels, {q6('avg(n)')} AS mean, min(n) AS min, {q6('quantile_cont(n, 0.25)')} AS p25, {q6('quantile_cont(n, 0.5)')} AS p50, {q6('quantile_cont(n, 0.75)')} AS p75, max(n) AS max FROM o""")
def voxel_occupancy_profile(spark, sf):
    p = voxels.occupancy_profile(vox(spark, sf))
    return p.select("voxels", r6("mean").alias("mean"), "min", *(r6(c).alias(c) for c in ("p25", "p50", "p75")), "max")


@query(f"""WITH {PTS}, {vox_sql()} SELECT vx, vy, vz, count(*) AS num_points, {q6('avg(x)')} AS x, {q6('avg(y)')} AS y, {q6('avg(z)')} AS z FROM vox WHERE value < 50 GROUP BY vx, vy, vz HAVING count(*) >= 10""")
def voxel_filtered_export(spark, sf):
    """Filter by curvature (value), key by the full cloud's origin, keep voxels with enough points."""
    full = pts(spark, sf)
    kept = voxels.downsample(voxels.with_voxels(full.where("value < 50"), SIZE, full)).where("num_points >= 10")
    return kept.select(*KEY, "num_points", *(r6(c).alias(c) for c in "xyz"))


@query(f"""WITH {PTS}, {vox_sql()} SELECT vx, vy, vz, {', '.join(q6(f'l{c} + (v{c} + 0.5) * {SIZE}') + f' AS center_{c}' for c in 'xyz')} FROM (SELECT DISTINCT vx, vy, vz, lx, ly, lz FROM vox)""")
def voxel_centers(spark, sf):
    p = pts(spark, sf)
    low = voxels.bounds(p)
    keys = voxels.with_voxels(p, SIZE).select(*KEY).distinct().crossJoin(F.broadcast(low))
    return keys.select(*KEY, *(r6(voxels.voxel_centre(c, F.col(f"min_{c}"), SIZE)).alias(f"center_{c}") for c in "xyz"))


@query(f"""WITH {PTS}, {vox_sql()}, o AS (SELECT vx, vy, vz, {' + '.join(f'CASE WHEN {c} < l{c} + (v{c} + 0.5) * {SIZE} THEN 0 ELSE {1 << k} END' for k, c in enumerate('xyz'))} AS octant FROM vox)
 SELECT vx, vy, vz, CAST(octant AS INTEGER) AS octant, count(*) AS n FROM o GROUP BY ALL""")
def octant_index(spark, sf):
    p = pts(spark, sf)
    return hemisphere.octants(voxels.with_voxels(p, SIZE), SIZE, voxels.bounds(p)).groupBy(*KEY, "octant").agg(F.count(F.lit(1)).alias("n"))


PLANE = "a b c d rmse curvature".split()


@query(f"WITH {PTS}, {vox_sql()}, {fit_sql('vox', KEY)} SELECT vx, vy, vz, n, {', '.join(f'{q6(c)} AS {c}' for c in PLANE)}, {q6(dip_sql())} AS dip, {q6(dir_sql())} AS dip_dir FROM fit WHERE n >= {LEAST}")
def plane_fit_voxel(spark, sf, size=SIZE):
    f = plane_fit(vox(spark, sf, size), KEY).where(F.col("n") >= LEAST)
    n = V.vec("a", "b", "c")
    return f.select(*KEY, "n", *(r6(c).alias(c) for c in PLANE), r6(V.dip(n)).alias("dip"), r6(V.dip_direction(n)).alias("dip_dir"))


@query(f"WITH {PTS}, {vox_sql()}, w AS (SELECT *, 1e0 / (1e0 + value) AS weight FROM vox), {fit_sql('w', ['fam'], weight='weight')} SELECT fam, n, {', '.join(f'{q6(c)} AS {c}' for c in PLANE)} FROM fit")
def plane_fit_weighted(spark, sf):
    p = pts(spark, sf).withColumn("weight", 1.0 / (1.0 + F.col("value")))
    return plane_fit(p, ["fam"], "weight").select("fam", "n", *(r6(c).alias(c) for c in PLANE))


@query(f"WITH {PTS}, {fit_sql('pts', [])} SELECT n, {', '.join(f'(round({v}, 4) + 0.0) AS {c}' for v, c in (('a', 'a'), ('b', 'b'), ('c', 'c'), (dip_sql(), 'dip'), (dir_sql(), 'dip_dir')))} FROM fit")
def cloud_slope(spark, sf):
    """The whole cloud's plane, to four places: the closed form loses half its digits where two eigenvalues nearly agree."""
    f = plane_fit(pts(spark, sf), [])
    n = V.vec("a", "b", "c")
    out = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "dip": V.dip(n), "dip_dir": V.dip_direction(n)}
    return f.select("n", *((F.round(v, 4) + F.lit(0.0)).alias(c) for c, v in out.items()))


@query(f"""WITH {PTS}, {fit_sql('pts', ['fam'])} SELECT point_id, {q6('a*x+b*y+c*z+d')} AS signed, {q6('abs(a*x+b*y+c*z+d)')} AS distance, {q6('(2e0*a*x+2e0*b*y+2e0*c*z+2e0*d)/sqrt(4e0*(a*a+b*b+c*c))')} AS normalised
 FROM (SELECT pts.*, a, b, c, d FROM pts JOIN fit USING (fam))""")
def point_plane_distance(spark, sf):
    p = pts(spark, sf)
    f = plane_fit(p, ["fam"]).select("fam", "a", "b", "c", "d")
    n, at = V.vec("a", "b", "c"), V.vec("x", "y", "z")
    signed = V.plane_distance(n, F.col("d"), at)
    twice = V.normalised_plane_distance(tuple(2.0 * c for c in n), 2.0 * F.col("d"), at)
    return p.join(f, "fam").select("point_id", r6(signed).alias("signed"), r6(F.abs(signed)).alias("distance"), r6(twice).alias("normalised"))


@query(f"WITH {PTS} SELECT point_id, {q6('sqrt(x*x + y*y + z*z)')} AS range, {q6('sqrt((x-1e0)*(x-1e0) + (y-1e0)*(y-1e0) + (z-2e1)*(z-2e1))')} AS to_core FROM pts")
def range_feature(spark, sf):
    p = pts(spark, sf)
    at = V.vec("x", "y", "z")
    core = (F.lit(1.0), F.lit(1.0), F.lit(20.0))
    return p.select("point_id", r6(V.length(at)).alias("range"), r6(V.length(V.minus(at, core))).alias("to_core"))


@query(f"WITH {PTS} SELECT point_id, fam FROM pts WHERE (x-1e0)*(x-1e0) + (y-1e0)*(y-1e0) + (z-2e1)*(z-2e1) <= 9e0")
def radius_filter(spark, sf):
    at, core = V.vec("x", "y", "z"), (F.lit(1.0), F.lit(1.0), F.lit(20.0))
    off = V.minus(at, core)
    return pts(spark, sf).where(V.dot(off, off) <= 9.0).select("point_id", "fam")


@query(f"""WITH {PTS}, {vox_sql()}, k AS (SELECT DISTINCT vx, vy, vz FROM vox)
 SELECT a.vx, a.vy, a.vz, count(*) AS neighbors FROM k a JOIN k b ON abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 AND (a.vx <> b.vx OR a.vy <> b.vy OR a.vz <> b.vz) GROUP BY ALL""")
def neighbor26_join(spark, sf):
    return neighbours.neighbour_voxels(vox(spark, sf).select(*KEY).distinct()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("neighbors"))


D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


@query(f"WITH {PTS} SELECT a.point_id, count(*) AS neighbors, {q6(f'sum(sqrt({D2}))')} AS total FROM pts a JOIN pts b ON {D2} <= 9e-2 GROUP BY a.point_id")
def radius_join_counts(spark, sf):
    p = pts(spark, sf)
    return blocks.radius_counts(p, 0.3).select("point_id", "neighbors", r6("total").alias("total"))


K = 12
KNN = f"""near AS (SELECT a.point_id AS a_id, unnest(min(ROW({D2}, b.point_id), {K})) AS m FROM pts a, pts b GROUP BY a.point_id),
 knn AS (SELECT a_id, m[1] AS d2, m[2] AS b_id FROM near)"""


@query(f"WITH {PTS}, {KNN} SELECT a_id, b_id, {q6('sqrt(d2)')} AS distance, CAST(row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS INTEGER) AS rank FROM knn")
def knn_join(spark, sf):
    p = pts(spark, sf)
    return neighbours.knn_join(p, p, K).select("a_id", "b_id", r6(F.sqrt("d2")).alias("distance"), "rank")


@query(f"""WITH {PTS}, r AS (SELECT point_id, x + 3e-2 AS x, y - 2e-2 AS y, z FROM pts),
 near AS (SELECT a.point_id, min(ROW({D2}, b.point_id)) AS m FROM pts a, r b GROUP BY a.point_id)
 SELECT near.point_id, m[2] AS from_id, {q6('e.value')} AS curvature FROM near JOIN events e ON e.event_id = m[2]""")
def nn1_curvature_map(spark, sf):
    """Every point takes the curvature (value) of the nearest point of another cloud (the same points, shifted)."""
    p = pts(spark, sf)
    other = p.withColumns({"x": F.col("x") + 0.03, "y": F.col("y") - 0.02})
    near = neighbours.knn_join(p, other, 1).select(F.col("a_id").alias("point_id"), F.col("b_id").alias("from_id"))
    return near.join(other.select(F.col("point_id").alias("from_id"), "value"), "from_id").select("point_id", "from_id", r6("value").alias("curvature"))


@query(f"""WITH {PTS}, {KNN}, nb AS (SELECT a_id AS point_id, p.x, p.y, p.z FROM knn JOIN pts p ON p.point_id = b_id), {fit_sql('nb', ['point_id'])}
 SELECT point_id, {q6('a')} AS nx, {q6('b')} AS ny, {q6('c')} AS nz, {q6('curvature')} AS curvature FROM fit""")
def normals_curvature_knn(spark, sf):
    return point_normals(pts(spark, sf), K).select("point_id", *(r6(c).alias(c) for c in ("nx", "ny", "nz")), r6("curvature").alias("curvature"))


def point_normals(p: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """point_id with the normal and curvature of its k nearest points; NULL normal and curvature 0 where they fix no plane."""
    return neighbours.nearest_planes(p, k, cell).select("point_id", F.col("a").alias("nx"), F.col("b").alias("ny"), F.col("c").alias("nz"), F.when(F.col("a").isNull(), 0.0).otherwise(F.col("curvature")).alias("curvature"))


SA, EPS, LEAST_OCTANT = 10.0, 0.01, 5

_COP = f"coalesce(l1 > {SA} * l0 AND l0 < {EPS}, false)"
_LEAVES = f"""{PTS}, {vox_sql()}, {fit_sql('vox', KEY)},
 kinds AS (SELECT *, CASE WHEN n <= 5 THEN 'spa' WHEN {_COP} THEN 'cop' ELSE 'non' END AS kind FROM fit),
 parted AS (SELECT v.*, {' + '.join(f'CASE WHEN v.{c} < v.l{c} + (v.v{c} + 0.5) * {SIZE} THEN 0 ELSE {1 << k} END' for k, c in enumerate('xyz'))} AS octant FROM vox v JOIN kinds USING (vx, vy, vz) WHERE kind = 'non'),
 {fit_sql('parted', [*KEY, 'octant'], 'pf')},
 leaves AS (SELECT vx, vy, vz, -1 AS octant, {SIZE} AS size, n, a, b, c, l0, l1, kind FROM kinds WHERE kind <> 'non'
  UNION ALL SELECT vx, vy, vz, octant, {SIZE} / 2, n, a, b, c, l0, l1, CASE WHEN n <= {LEAST_OCTANT} THEN 'spa' WHEN {_COP} THEN 'cop' ELSE 'non' END FROM pf)"""


@query(f"""WITH {PTS}, {vox_sql()}, {fit_sql('vox', KEY)} SELECT vx, vy, vz, n, CASE WHEN n <= 5 THEN 'spa' WHEN {_COP} THEN 'cop' ELSE 'non' END AS kind FROM fit""")
def coplanarity_test(spark, sf):
    return hemisphere.coplanarity(vox(spark, sf), SA, EPS, 5).select(*KEY, "n", "kind")


def moe_leaves(spark, sf):
    p = pts(spark, sf)
    return hemisphere.two_levels(voxels.with_voxels(p, SIZE), SIZE, voxels.bounds(p), SA, EPS, 5, LEAST_OCTANT)


@query(f"WITH {_LEAVES} SELECT vx, vy, vz, CAST(octant AS INTEGER) AS octant, CAST(size AS DOUBLE) AS size, n, kind FROM leaves")
def two_level_voxels(spark, sf):
    """Coplanar and sparse voxels, and the octants of the others with their own kinds."""
    return moe_leaves(spark, sf).select(*KEY, F.col("octant").cast("int").alias("octant"), F.col("size").cast("double").alias("size"), "n", "kind")


_AZIMUTH = "CASE WHEN abs(a) < 1e-12 AND abs(b) < 1e-12 THEN 0e0 WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360e0 ELSE degrees(atan2(b, a)) END"
_MOE = f"""{_LEAVES}, cloud AS (SELECT CAST(count(*) AS DOUBLE) AS total, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM pts),
 par AS (SELECT least(90, CAST(round_even({dip_sql()}, 0) AS INTEGER)) AS p0, CAST(floor({_AZIMUTH}) AS INTEGER) % 360 AS t0, greatest(5e-1, 5e0 * {SA} / CASE WHEN l0 > 0 THEN l1 / l0 ELSE {SA} END) AS s, 5e-1 * size / extent + 5e-1 * n / total AS w FROM leaves, cloud WHERE kind = 'cop'),
 rch AS (SELECT *, greatest(1, CAST(round_even(s, 0) AS INTEGER)) AS h FROM par),
 vp AS (SELECT *, unnest(range(-h, h + 1)) AS dp FROM rch), vt AS (SELECT *, unnest(range(-h, h + 1)) AS dt FROM vp),
 votes AS (SELECT CAST(p0 + dp AS INTEGER) AS phi, CAST((t0 + dt + 360) % 360 AS INTEGER) AS theta, sum(w * exp(-5e-1 * (dp*dp + dt*dt) / (s*s))) AS votes FROM vt WHERE p0 + dp BETWEEN 0 AND 90 GROUP BY 1, 2)"""


def moe_accumulator(spark, sf):
    p = pts(spark, sf)
    sides = [F.max(c) - F.min(c) for c in "xyz"]
    cloud = p.agg(F.count(F.lit(1)).cast("double").alias("total"), F.greatest(*sides).alias("extent"))
    return hemisphere.votes(moe_leaves(spark, sf).crossJoin(F.broadcast(cloud)), SA, F.col("extent"), F.col("total"))  # one row


@query(f"WITH {_MOE} SELECT phi, theta, {q6('votes')} AS votes FROM votes")
def moe_votes(spark, sf):
    return moe_accumulator(spark, sf).select("phi", "theta", r6("votes").alias("votes"))


@query(f"""WITH {_MOE}, rv AS (SELECT phi, theta, {q6('votes')} AS votes FROM votes), nb AS (SELECT a.phi, a.theta, max(b.votes) AS best FROM rv a JOIN rv b ON abs(a.phi - b.phi) <= 1 AND ((a.theta - b.theta + 361) % 360) <= 2 AND NOT (a.phi = b.phi AND a.theta = b.theta) GROUP BY ALL)
 SELECT rv.phi, rv.theta, rv.votes FROM rv LEFT JOIN nb ON rv.phi = nb.phi AND rv.theta = nb.theta WHERE rv.votes > 1e-1 AND rv.votes >= coalesce(nb.best, 0e0)""")
def moe_peaks(spark, sf):
    rounded = moe_accumulator(spark, sf).select("phi", "theta", r6("votes").alias("votes"))
    return hemisphere.peaks(rounded, 0.1)


_AXES = """ax AS (SELECT *, CASE WHEN abs(c) > 0.9 THEN 0e0 ELSE 1e0 END AS rz, CASE WHEN abs(c) > 0.9 THEN 1e0 ELSE 0e0 END AS ry FROM fit),
 a1 AS (SELECT *, ry*c - rz*b AS u1, rz*a AS u2, -ry*a AS u3 FROM ax), a2 AS (SELECT *, sqrt(u1*u1+u2*u2+u3*u3) AS ul FROM a1),
 a3 AS (SELECT *, u1/ul AS ua, u2/ul AS ub, u3/ul AS uc FROM a2), axes AS (SELECT *, b*uc - c*ub AS va, c*ua - a*uc AS vb, a*ub - b*ua AS vc FROM a3)"""
_UV = "(ua*(x-cx) + ub*(y-cy) + uc*(z-cz))", "(va*(x-cx) + vb*(y-cy) + vc*(z-cz))"
_BAND = f"""{PTS}, {vox_sql()}, {fit_sql('vox', KEY)}, {_AXES},
 cells AS (SELECT vx, vy, vz, CAST(floor({_UV[0]} / 0.5) AS BIGINT) AS ci, CAST(floor({_UV[1]} / 0.5) AS BIGINT) AS cj FROM vox JOIN axes USING (vx, vy, vz) WHERE axes.n >= {LEAST} AND abs(a*x+b*y+c*z+d) <= 0.03)"""


def band(spark, sf):
    v = vox(spark, sf)
    return patches.band_cells(v, plane_fit(v, KEY).where(F.col("n") >= LEAST), 0.03, 0.5)


@query(f"WITH {_BAND} SELECT vx, vy, vz, ci, cj, count(*) AS n FROM cells GROUP BY ALL")
def thickness_band_cells(spark, sf):
    return band(spark, sf).groupBy(*KEY, "ci", "cj").agg(F.count(F.lit(1)).alias("n"))


_COMP = f"""RECURSIVE {_BAND}, k AS (SELECT vx, vy, vz, ci, cj, count(*) AS n FROM cells GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz, ci, cj) AS id FROM k),
 e AS (SELECT a.id AS x, b.id AS y FROM i a JOIN i b ON a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz AND abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS comp FROM r GROUP BY x),
 s AS (SELECT vx, vy, vz, comp, sum(n) AS size, count(*) AS cells FROM i JOIN c ON i.id = c.x GROUP BY ALL)"""


@query(f"WITH {_COMP} SELECT vx, vy, vz, CAST(size AS BIGINT) AS size, cells FROM s")
def connected_components_grid(spark, sf):
    """Sizes (points and cells) of the connected parts of every voxel's plane, cells touching at sides and corners."""
    c = patches.cell_components(band(spark, sf), KEY)
    return c.groupBy(*KEY, "component").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells")).drop("component")


@query(f"WITH {_COMP} SELECT vx, vy, vz, CAST(max(size) AS BIGINT) AS size FROM s GROUP BY ALL")
def largest_patch_component(spark, sf):
    c = patches.cell_components(band(spark, sf), KEY)
    return patches.largest_component(c, KEY).select(*KEY, "size").distinct()


THR = 0.015
_LSQ = f"""{PTS}, {vox_sql()}, {fit_sql('vox', KEY)}, pn AS (SELECT v.*, f.a, f.b, f.c, f.d, coalesce(abs(f.a*x+f.b*y+f.c*z+f.d) <= {THR}, false) AS near FROM vox v LEFT JOIN (SELECT * FROM fit WHERE n >= {LEAST} AND a IS NOT NULL) f USING (vx, vy, vz)),
 cn AS (SELECT vx, vy, vz, count(*) FILTER (WHERE near) AS inliers FROM pn GROUP BY ALL),
 seeds AS (SELECT fit.*, inliers FROM fit JOIN cn USING (vx, vy, vz) WHERE inliers >= {LEAST} AND fit.n >= {LEAST} AND fit.a IS NOT NULL)"""


def lsq(spark, sf):
    return patches.least_squares_patches(vox(spark, sf), THR, LEAST)


@query(f"WITH {_LSQ} SELECT vx, vy, vz, n, inliers, {q6('rmse')} AS rmse FROM seeds")
def voxel_seed_patches(spark, sf):
    return lsq(spark, sf)[0].select(*KEY, "n", "inliers", r6("rmse").alias("rmse"))


_EDGE = f"""{_LSQ}, rest AS (SELECT p.* EXCLUDE (a, b, c, d) FROM pn p LEFT JOIN seeds s USING (vx, vy, vz) WHERE NOT (p.near AND s.vx IS NOT NULL)),
 {fit_sql('rest', KEY, 'ef')}, ed AS (SELECT vx, vy, vz, a AS ea, b AS eb, c AS ec FROM ef WHERE n >= 5 AND a IS NOT NULL),
 rt AS (SELECT ed.vx, ed.vy, ed.vz, s.vx AS nx, s.vy AS ny, s.vz AS nz, avg(abs(s.a*x+s.b*y+s.c*z+s.d)) AS mw, min(degrees(acos(least(1e0, abs(ea*s.a+eb*s.b+ec*s.c))))) AS nw
  FROM ed JOIN seeds s ON abs(ed.vx-s.vx) <= 1 AND abs(ed.vy-s.vy) <= 1 AND abs(ed.vz-s.vz) <= 1 AND (ed.vx <> s.vx OR ed.vy <> s.vy OR ed.vz <> s.vz)
  JOIN rest r ON r.vx = ed.vx AND r.vy = ed.vy AND r.vz = ed.vz GROUP BY ALL),
 ok AS (SELECT *, mw < 1e0 AS okd, nw < 1e1 AS oka, mw / 1e0 + nw / 1e1 AS pw FROM rt),
 bst AS (SELECT vx, vy, vz, bool_or(okd AND oka) AS any_ok, bool_or(okd) AS any_d, bool_or(oka) AS any_a, min(ROW(pw, nx, ny, nz)) FILTER (WHERE okd AND oka) AS m FROM ok GROUP BY ALL)"""


@query(f"""WITH {_EDGE} SELECT ed.vx, ed.vy, ed.vz, CASE WHEN any_ok IS NULL THEN 'no_neighbor_cluster' WHEN any_ok THEN 'merged' WHEN NOT any_d AND NOT any_a THEN 'blocked_by_distance_and_angle'
  WHEN NOT any_d THEN 'blocked_by_edge_distance' WHEN NOT any_a THEN 'blocked_by_edge_angle' ELSE 'blocked_unknown' END AS merge_reason,
  m[2] AS nx, m[3] AS ny, m[4] AS nz, {q6('m[1]')} AS pw FROM ed LEFT JOIN bst USING (vx, vy, vz)""")
def edge_patch_match(spark, sf):
    seeds, p = lsq(spark, sf)
    rest = p.where("NOT on_plane")
    edge = plane_fit(rest, KEY).where("n >= 5 AND a IS NOT NULL")
    return patches.edge_matches(edge, seeds, rest, 1.0, 10.0).select(*KEY, "merge_reason", "nx", "ny", "nz", r6("pw").alias("pw"))


@query(f"""WITH {PTS}, {vox_sql()}, m AS (SELECT DISTINCT fam * 1000 + vx * 30 + vy AS patch, vx, vy, vz FROM vox)
 SELECT DISTINCT a.patch AS p, b.patch AS q FROM m a JOIN m b ON a.patch < b.patch AND abs(a.vx-b.vx) <= 1 AND abs(a.vy-b.vy) <= 1 AND abs(a.vz-b.vz) <= 1""")
def patch_adjacency(spark, sf):
    return patches.patch_adjacency(vox(spark, sf).withColumn("patch", F.col("fam") * 1000 + F.col("vx") * 30 + F.col("vy")))


_MERGE = f"""{PTS}, {vox_sql()}, {fit_sql('vox', KEY)}, pt AS (SELECT vx || '_' || vy || '_' || vz AS patch, * FROM fit WHERE n >= {LEAST} AND a IS NOT NULL),
 mg AS (SELECT p.patch AS p, q.patch AS q, degrees(acos(least(1e0, abs(p.a*q.a+p.b*q.b+p.c*q.c)))) AS ang, abs(p.a*q.cx+p.b*q.cy+p.c*q.cz+p.d) AS dst, sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cz-q.cz)*(p.cz-q.cz)) AS gap
  FROM pt p JOIN pt q ON p.patch < q.patch AND abs(p.vx-q.vx) <= 1 AND abs(p.vy-q.vy) <= 1 AND abs(p.vz-q.vz) <= 1)"""


@query(f"""WITH {_MERGE} SELECT p, q, {q6('ang')} AS ang_diff, {q6('dst')} AS dist_diff, {q6('gap')} AS centroid_diff, ang < 5e0 AS pass_angle, dst < 5e-1 AS pass_distance, gap < 6e0 AS pass_centroid, ang < 5e0 AND dst < 5e-1 AND gap < 6e0 AS merge FROM mg""")
def patch_merge_decisions(spark, sf):
    m = voxel_patch_pairs(spark, sf)[2]
    return m.select("p", "q", *(r6(c).alias(c) for c in ("ang_diff", "dist_diff", "centroid_diff")), "pass_angle", "pass_distance", "pass_centroid", "merge")


def voxel_patch_pairs(spark, sf):
    v = vox(spark, sf)
    # Written once: the fits are met four times.
    f = written(plane_fit(v, KEY).where(f"n >= {LEAST} AND a IS NOT NULL").withColumn("patch", voxels.voxel_name()), "patch-fits")
    near = patches.patch_adjacency(f)
    return f, near, patches.mergeable(f, near, 5.0, 0.5, SIZE)


@query(f"""WITH RECURSIVE {_MERGE}, e AS (SELECT p AS x, q AS y FROM mg WHERE ang < 5e0 AND dst < 5e-1 AND gap < 6e0 UNION SELECT q, p FROM mg WHERE ang < 5e0 AND dst < 5e-1 AND gap < 6e0 UNION SELECT patch, patch FROM pt),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS patch, min(y) AS disc FROM r GROUP BY x""")
def patch_merge_components(spark, sf):
    f, near, _ = voxel_patch_pairs(spark, sf)
    return patches.merge_patches(f, near, 5.0, 0.5, SIZE)


@query(f"""WITH {_LSQ}, st AS (SELECT p.vx, p.vy, p.vz, near AND s.vx IS NOT NULL AS on_plane, value, z FROM pn p LEFT JOIN seeds s USING (vx, vy, vz))
 SELECT vx, vy, vz, count(*) AS n_total, count(*) FILTER (WHERE on_plane) AS n_patch, {', '.join(f'{q9(f"{f} FILTER (WHERE {flag})")} AS {name}_value_{s}' for name, flag in (('patch', 'on_plane'), ('other', 'NOT on_plane')) for s, f in (('mean', 'avg(value)'), ('std', 'stddev_pop(value)'), ('p50', 'quantile_cont(value, 0.5)'), ('p90', 'quantile_cont(value, 0.9)')))},
 {', '.join(f'{q9(f"{f} FILTER (WHERE on_plane) - {f} FILTER (WHERE NOT on_plane)")} AS diff_value_{s}' for s, f in (('mean', 'avg(value)'), ('std', 'stddev_pop(value)'), ('p50', 'quantile_cont(value, 0.5)'), ('p90', 'quantile_cont(value, 0.9)')))} FROM st GROUP BY vx, vy, vz""")
def voxel_distribution_stats(spark, sf):
    from ..operators.statistics import patch_statistics

    s = patch_statistics(lsq(spark, sf)[1], KEY, F.col("on_plane"), ["value"])
    return s.select(*KEY, "n_total", "n_patch", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in s.columns if "_value_" in c))


@query(f"""WITH {PTS}, q AS (SELECT quantile_cont(value, 0.3) AS k0 FROM pts) SELECT point_id, {q6('greatest(exp(-(value / greatest(k0, 1e-12)) * (value / greatest(k0, 1e-12))), 5e-2)')} AS weight FROM pts, q""")
def curvature_weight_table(spark, sf):
    return curvature_weights(pts(spark, sf), "value", 0.3, 0.05).select("point_id", r6("weight").alias("weight"))


_CAND = """hs AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY ((point_id % 1000003) * 48271 + 12345) % 2147483647, point_id) - 1 AS place FROM pts),
 cand AS (SELECT a.fam * 10 + a.place // 3 AS cand, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.z - a.z AS qz
  FROM hs a JOIN hs b ON a.fam = b.fam AND b.place = a.place + 1 JOIN hs c ON a.fam = c.fam AND c.place = a.place + 2 WHERE a.place < 30 AND a.place % 3 = 0),
 cn AS (SELECT *, py*qz - pz*qy AS n1, pz*qx - px*qz AS n2, px*qy - py*qx AS n3 FROM cand), cl AS (SELECT *, sqrt(n1*n1+n2*n2+n3*n3) AS l FROM cn),
 planes AS (SELECT cand, n1/l AS a, n2/l AS b, n3/l AS c, -(n1/l*ax + n2/l*ay + n3/l*az) AS d FROM cl WHERE l >= 1e-8)"""


def fixed_candidates(p: DataFrame) -> DataFrame:
    """Ten triples of every family, by a hash over all of its points."""
    few = None
    for fam in range(4):
        one = p.where(F.col("fam") == fam).orderBy(voxels.hash_order("point_id"), "point_id").limit(30).select("fam", "point_id", "x", "y", "z")
        few = one if few is None else few.unionByName(one)
    place = F.row_number().over(Window.partitionBy("fam").orderBy(voxels.hash_order("point_id"), "point_id")) - 1  # of thirty rows
    few = few.withColumn("place", place).withColumn("cand", (F.col("fam") * 10 + F.floor(F.col("place") / 3)).cast("long"))
    out = None
    for k, name in enumerate("pqr"):
        one = few.where(F.col("place") % 3 == k).select("cand", *(F.col(c).alias(f"{name}{c}") for c in "xyz"))
        out = one if out is None else out.join(one, "cand")
    n, d = V.plane_through(*(V.vec(*(f"{s}{c}" for c in "xyz")) for s in "pqr"))
    return out.select("cand", *(v.alias(c) for v, c in zip(n, "abc")), d.alias("d")).where("a IS NOT NULL")


@query(f"WITH {PTS}, {_CAND} SELECT cand, count(*) FILTER (WHERE abs(a*x+b*y+c*z+d) <= 5e-2) AS inliers, {q6('sum(1e0 / (1e0 + value) * exp(-(a*x+b*y+c*z+d)*(a*x+b*y+c*z+d) / (2e0*4e-4)))')} AS score FROM pts, planes GROUP BY cand")
def ransac_score_candidates(spark, sf):
    p = pts(spark, sf).withColumn("w", 1.0 / (1.0 + F.col("value")))
    return ransac.scores(p, fixed_candidates(p), 0.05, 0.02, "w").select("cand", "inliers", r6("score").alias("score"))


@query(f"""WITH {PTS}, {_CAND}, sc AS (SELECT cand, count(*) FILTER (WHERE abs(a*x+b*y+c*z+d) <= 5e-2) AS inliers FROM pts, planes GROUP BY cand), best AS (SELECT p.* FROM planes p JOIN sc USING (cand) ORDER BY inliers DESC, cand LIMIT 1),
 inl AS (SELECT best.cand, x, y, z FROM pts, best WHERE abs(a*x+b*y+c*z+d) <= 5e-2), {fit_sql('inl', ['cand'])} SELECT cand, n, {', '.join(f'{q6(c)} AS {c}' for c in 'a b c d rmse'.split())} FROM fit""")
def ransac_best_plane(spark, sf):
    p = pts(spark, sf)
    return ransac.best_plane(p, fixed_candidates(p), 0.05).select("cand", "n", *(r6(c).alias(c) for c in "a b c d rmse".split()))


def flagship(spark, folder):
    return plane_fit_voxel(spark, folder, 5.0)


_GRID = f"{PTS}, g AS (SELECT x, y, z, CAST(floor(x / 4e0) AS BIGINT) AS vx, CAST(floor(y / 4e0) AS BIGINT) AS vy, CAST(floor(z / 4e0) AS BIGINT) AS vz FROM pts), {fit_sql('g', KEY)}"


@query(f"WITH {_GRID} SELECT vx, vy, vz, n, {', '.join(f'{q6(c)} AS {c}' for c in 'a b c d rmse'.split())} FROM fit WHERE n >= 50")
def voxel_plane_sums(spark, sf):
    """The streaming form of the voxel fit, on a fixed grid, run as a batch."""
    from ..streaming.voxel_planes import voxel_planes

    f = voxel_planes(pts(spark, sf), 4.0).where("n >= 50")
    return f.select(*KEY, "n", *(r6(c).alias(c) for c in "a b c d rmse".split()))
