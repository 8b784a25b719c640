"""Queries on plane orientations: conversion, quality, layers, weights, density and fuzzy clusters."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import orientation_clusters as O
from ..shared_store import written
from ..tables import table
from .fixtures import ORIENT, orient, q6, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DIP = "degrees(atan2(sqrt(nx*nx + ny*ny), abs(nz)))"
_DIR = "(CASE WHEN degrees(atan2(nx, ny)) < 0 THEN degrees(atan2(nx, ny)) + 360e0 ELSE degrees(atan2(nx, ny)) END)"
_OD = f"{ORIENT}, od AS (SELECT *, {_DIP} AS dip, {_DIR} AS dip_dir FROM orient)"


def with_dips(o):
    n = V.vec("nx", "ny", "nz")
    return o.withColumns({"dip": V.dip(n), "dip_dir": V.dip_direction(n)})


@query(f"WITH {_OD} SELECT disc_id, {q6('dip')} AS dip, {q6('dip_dir')} AS dip_dir, {q6('tan(radians(dip) / 2e0)')} AS stereo_r, {q6('(dip_dir + 270e0) - 360e0 * floor((dip_dir + 270e0) / 360e0)')} AS strike FROM od")
def dip_dipdir(spark, sf):
    d = with_dips(orient(spark, sf))
    strike = F.pmod(F.col("dip_dir") + 270.0, F.lit(360.0))
    return d.select("disc_id", r6("dip").alias("dip"), r6("dip_dir").alias("dip_dir"), r6(F.tan(F.radians("dip") / 2.0)).alias("stereo_r"), r6(strike).alias("strike"))


@query(f"WITH {_OD} SELECT disc_id, {q6('sin(radians(dip)) * sin(radians(dip_dir))')} AS nx, {q6('sin(radians(dip)) * cos(radians(dip_dir))')} AS ny, {q6('cos(radians(dip))')} AS nz FROM od")
def dipdir_to_normal(spark, sf):
    n = V.normal_of(F.col("dip"), F.col("dip_dir"))
    return with_dips(orient(spark, sf)).select("disc_id", *(r6(c).alias(name) for c, name in zip(n, ("nx", "ny", "nz"))))


@query(f"""WITH {ORIENT} SELECT a.disc_id AS i, b.disc_id AS j, {q6('degrees(acos(least(1e0, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz))))')} AS angle
 FROM orient a JOIN orient b ON a.disc_id < b.disc_id AND degrees(acos(least(1e0, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) <= 8e0""")
def plane_angle_pairs(spark, sf):
    """Pairs of planes at most 8 degrees apart."""
    o = orient(spark, sf)
    return O.angular_pairs(o, 8.0).select("i", "j", r6("angle").alias("angle"))


_Q = f"""{ORIENT}, base AS (SELECT o.*, CAST(embedding[4] AS DOUBLE) * CAST(embedding[4] AS DOUBLE) AS rmse, abs(CAST(embedding[5] AS DOUBLE)) AS trace FROM orient o JOIN embeddings e ON e.vec_id = o.disc_id),
 nm AS (SELECT *, (rmse - min(rmse) OVER ()) / (max(rmse) OVER () - min(rmse) OVER ()) AS rn, (trace - min(trace) OVER ()) / (max(trace) OVER () - min(trace) OVER ()) AS tn FROM base),
 qs AS (SELECT *, (6e-1 * (1e0 - rn) + 4e-1 * tn) / 1e0 AS q FROM nm),
 ly AS (SELECT *, row_number() OVER (ORDER BY q DESC, disc_id) AS q_rank, count(*) OVER () AS n FROM qs),
 fl AS (SELECT *, q_rank <= greatest(1, round_even(3e-1 * n, 0)) AS first_layer, greatest(1e0, round_even(3e-1 * n, 0)) AS n1 FROM ly),
 al AS (SELECT *, CASE WHEN first_layer THEN 1e0 WHEN (q_rank - n1) / nullif(n - n1, 0) < 2e-1 THEN 8e-1 WHEN (q_rank - n1) / nullif(n - n1, 0) < 4e-1 THEN 6e-1 WHEN (q_rank - n1) / nullif(n - n1, 0) < 6e-1 THEN 4e-1
   WHEN (q_rank - n1) / nullif(n - n1, 0) < 8e-1 THEN 2e-1 ELSE 1e-1 END AS s, CASE WHEN n - q_rank < round_even(3e-1 * n, 0) THEN exp(-rn) ELSE 1e0 END AS beta FROM fl),
 ds AS (SELECT *, s * beta AS alpha FROM al)"""


def discs(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("disc_id"), *(F.element_at("embedding", k).cast("double").alias(f"e{k}") for k in (4, 5)))
    return orient(spark, sf).join(e, "disc_id").withColumns({"rmse": F.col("e4") * F.col("e4"), "trace": F.abs("e5")}).drop("e4", "e5")


def layered(spark, sf):
    return O.first_layer(O.quality(discs(spark, sf), w_rmse=0.6, w_trace=0.4), 0.3)


@query(f"WITH {_Q} SELECT disc_id, {q6('rn')} AS rmse_norm, {q6('tn')} AS trace_norm, {q6('q')} AS q FROM ds")
def quality_scores(spark, sf):
    return O.quality(discs(spark, sf), w_rmse=0.6, w_trace=0.4).select("disc_id", *(r6(c).alias(c) for c in ("rmse_norm", "trace_norm", "q")))


@query(f"WITH {_Q} SELECT disc_id, q_rank, first_layer FROM ds")
def first_layer_rank(spark, sf):
    return layered(spark, sf).select("disc_id", F.col("q_rank").cast("long").alias("q_rank"), "first_layer")


@query(f"WITH {_Q} SELECT disc_id, s, {q6('beta')} AS beta, {q6('alpha')} AS alpha, {q6('CASE WHEN first_layer THEN 1e0 ELSE greatest(1e-1, pow(q, 2e0)) END')} AS alpha_continuous FROM ds")
def sample_weights(spark, sf):
    w = O.sample_weights(layered(spark, sf), 0.3)
    both = O.continuous_weights(w.withColumn("alpha_1", F.col("alpha")), 2.0)
    return both.select("disc_id", "s", r6("beta").alias("beta"), r6("alpha_1").alias("alpha"), r6("alpha").alias("alpha_continuous"))


#: Three centres and five seeds as (x, y, z), normalised where they are used.
CENTRES = [(0.1, 0.2, 0.97), (0.7, 0.1, 0.7), (-0.5, 0.5, 0.7)]
SEEDS = [(0.12, 0.2, 0.96), (0.0, -0.9, 0.4), (0.02, -0.88, 0.42), (-0.9, 0.1, 0.3), (0.7, 0.12, 0.7)]


def _unit(v):
    n = sum(x * x for x in v) ** 0.5
    return tuple(x / n for x in v)


def _values(rows):
    return ", ".join(f"({k}, {', '.join(f'{x!r}e0' for x in _unit(r))})" for k, r in enumerate(rows))


_C = f"cen(k, mx, my, mz) AS (VALUES {_values(CENTRES)})"


@query(f"""WITH RECURSIVE {ORIENT}, cen AS (SELECT nx AS mx, ny AS my, nz AS mz FROM orient WHERE disc_id < 4), sd AS (SELECT disc_id - 4 AS i, nx AS x, ny AS y, nz AS z FROM orient WHERE disc_id BETWEEN 4 AND 60),
 acc(i, ids) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT acc.i + 1, CASE WHEN
   (SELECT min(degrees(acos(least(1e0, abs(s.x*mx + s.y*my + s.z*mz))))) FROM cen) > 2e1
   AND coalesce((SELECT min(degrees(acos(least(1e0, abs(s.x*t.x + s.y*t.y + s.z*t.z))))) FROM sd t WHERE list_contains(acc.ids, t.i)), 1e3) > 2e1
  THEN list_append(acc.ids, s.i) ELSE acc.ids END FROM acc JOIN sd s ON s.i = acc.i + 1)
 SELECT CAST(i AS BIGINT) AS seed, {q6('x')} AS nx, {q6('y')} AS ny, {q6('z')} AS nz FROM sd WHERE list_contains((SELECT max_by(ids, i) FROM acc), i)""")
def manual_seed_antijoin(spark, sf):
    """Seeds (the planes 4 to 60) that become centres of their own: farther than 20 degrees from the first four planes and from
    earlier seeds. Seeds and centres are lists of a few rows by nature."""
    o = orient(spark, sf).where("disc_id <= 60").orderBy("disc_id").select("disc_id", "nx", "ny", "nz").collect()
    centres, seeds = ([(r["nx"], r["ny"], r["nz"]) for r in o if (r["disc_id"] < 4) == first] for first in (True, False))
    kept = [c[:3] for c in O.with_seeds(centres, seeds, 20.0) if c[3]]
    return spark.createDataFrame([(seeds.index(s), *s) for s in kept], "seed long, nx double, ny double, nz double").select("seed", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


def centre_frame(spark):
    return spark.createDataFrame([(k, *_unit(c)) for k, c in enumerate(CENTRES)], "k int, mx double, my double, mz double")


def member(spark, sf, centres=None):
    w = O.sample_weights(layered(spark, sf), 0.3).select("disc_id", "nx", "ny", "nz", "alpha")
    return O.memberships(w, centres if centres is not None else centre_frame(spark))


_MU = f"""{_Q}, {_C}, an AS (SELECT disc_id, nx, ny, nz, alpha, k, mx, my, mz, greatest(acos(least(1e0, abs(nx*mx + ny*my + nz*mz))), 1e-12) AS angle FROM ds, cen),
 mu AS (SELECT *, pow(angle, -2e0) / sum(pow(angle, -2e0)) OVER (PARTITION BY disc_id) AS mu FROM an)"""


@query(f"WITH {_MU} SELECT disc_id, CAST(k AS INTEGER) AS k, {q6('mu')} AS mu FROM mu")
def fcm_membership(spark, sf):
    return member(spark, sf).select("disc_id", "k", r6("mu").alias("mu"))


_UP = f"""{_MU}, sm AS (SELECT k, sum(w * nx) AS sx, sum(w * ny) AS sy, sum(w * nz) AS sz FROM (SELECT *, alpha * mu * mu * CASE WHEN nx*mx + ny*my + nz*mz < 0 THEN -1e0 ELSE 1e0 END AS w FROM mu) GROUP BY k),
 up AS (SELECT k, sx / sqrt(sx*sx+sy*sy+sz*sz) AS mx, sy / sqrt(sx*sx+sy*sy+sz*sz) AS my, sz / sqrt(sx*sx+sy*sy+sz*sz) AS mz FROM sm)"""


@query(f"WITH {_UP} SELECT CAST(k AS INTEGER) AS k, {q6('mx')} AS mx, {q6('my')} AS my, {q6('mz')} AS mz FROM up")
def fcm_center_update(spark, sf):
    return O.centre_update(member(spark, sf)).select("k", *(r6(c).alias(c) for c in O.C))


@query(f"""WITH {_UP} SELECT CAST(a.k AS INTEGER) AS p, CAST(b.k AS INTEGER) AS q, {q6('degrees(acos(least(1e0, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz))))')} AS angle FROM up a JOIN up b ON a.k < b.k
 ORDER BY degrees(acos(least(1e0, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz)))), a.k, b.k LIMIT 1""")
def closest_center_pair(spark, sf):
    c = O.centre_update(member(spark, sf))
    a = c.select(F.col("k").alias("p"), *(F.col(x).alias(f"p{x}") for x in O.C))
    b = c.select(F.col("k").alias("q"), *(F.col(x).alias(f"q{x}") for x in O.C))
    both = a.join(b, F.col("p") < F.col("q")).withColumn("angle", V.plane_angle(V.vec("pmx", "pmy", "pmz"), V.vec("qmx", "qmy", "qmz")))
    return both.orderBy("angle", "p", "q").limit(1).select("p", "q", r6("angle").alias("angle"))


_AS = f"{_MU}, rk AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY mu DESC, k) AS r FROM mu), asg AS (SELECT disc_id, k AS label, mu, mu < 5e-1 AS noise FROM rk WHERE r = 1)"


@query(f"WITH {_AS} SELECT CAST(label AS INTEGER) AS k, count(*) AS members, {q6('sum(m.alpha * m.mu) / sum(m.alpha)')} AS confidence FROM asg JOIN mu m ON m.disc_id = asg.disc_id AND m.k = asg.label WHERE NOT noise GROUP BY label")
def cluster_assign_confidence(spark, sf):
    m = member(spark, sf)
    return O.confidence(m, O.assigned(m, 0.5)).select("k", "members", r6("confidence").alias("confidence"))


@query(f"WITH {_AS} SELECT disc_id, CAST(label AS INTEGER) AS label, {q6('mu')} AS mu, noise FROM asg")
def cluster_assignment(spark, sf):
    return O.assigned(member(spark, sf), 0.5).select("disc_id", "label", r6("mu").alias("mu"), "noise")


EPS, LEAST = 8.0, 7
_DB = f"""{ORIENT}, nb AS (SELECT a.disc_id AS a, b.disc_id AS b FROM orient a JOIN orient b ON degrees(acos(least(1e0, abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)))) <= {EPS}),
 core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {LEAST}), e AS (SELECT a AS x, b AS y FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), cc AS (SELECT x AS id, min(y) AS c FROM r GROUP BY x),
 nu AS (SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS label FROM cc), bo AS (SELECT nb.a AS id, min(label) AS label FROM nb JOIN nu ON nu.id = nb.b GROUP BY nb.a),
 db AS (SELECT o.*, CAST(coalesce(nu.label, bo.label, -1) AS BIGINT) AS cl FROM orient o LEFT JOIN nu ON nu.id = o.disc_id LEFT JOIN bo ON bo.id = o.disc_id)"""


def clustered(spark, sf):
    return O.angular_dbscan(orient(spark, sf).drop("label"), EPS, LEAST)


@query(f"WITH RECURSIVE {_DB} SELECT disc_id, cl AS label FROM db")
def angular_dbscan_labels(spark, sf):
    return clustered(spark, sf).select("disc_id", "label")


_CS = f"{_DB}, su AS (SELECT cl, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, count(*) AS members FROM db WHERE cl >= 0 GROUP BY cl), ct AS (SELECT cl, members, sx / sqrt(sx*sx+sy*sy+sz*sz) AS nx, sy / sqrt(sx*sx+sy*sy+sz*sz) AS ny, sz / sqrt(sx*sx+sy*sy+sz*sz) AS nz FROM su)"


@query(f"WITH RECURSIVE {_CS} SELECT cl AS label, members, {q6(_DIP)} AS dip, {q6(_DIR)} AS dip_dir FROM ct")
def cluster_summary(spark, sf):
    c = O.centres_of(clustered(spark, sf))
    n = V.vec(*O.C)
    return c.select("label", "members", r6(V.dip(n)).alias("dip"), r6(V.dip_direction(n)).alias("dip_dir"))


@query(f"WITH RECURSIVE {_CS} SELECT db.cl AS label, {q6('max(degrees(acos(least(1e0, abs(db.nx*ct.nx + db.ny*ct.ny + db.nz*ct.nz)))))')} AS radius FROM db JOIN ct USING (cl) GROUP BY db.cl")
def cluster_angular_radius(spark, sf):
    c = clustered(spark, sf)
    return O.angular_radius(c, O.centres_of(c)).select("label", r6("radius").alias("radius"))


@query(f"WITH RECURSIVE {_CS} SELECT cl AS cluster_id, printf('%.2f', {_DIP}) AS dip, printf('%.2f', {_DIR}) AS dipdir, members AS discontinuity_number FROM ct")
def cluster_table(spark, sf):
    from ..sources.sinks import cluster_table as write

    c = O.centres_of(clustered(spark, sf)).select(F.col("label").alias("k"), *O.C, "members", F.lit(1.0).alias("confidence"), F.lit(False).alias("is_manual_seed"))
    return write(c).select(F.col("Cluster_id").alias("cluster_id"), F.col("Dip").alias("dip"), F.col("Dipdir").alias("dipdir"), F.col("Discontinuity_Number").alias("discontinuity_number"))


@query()
def fuzzy_clustering(spark, sf):
    """The whole run: quality, first layer, density clusters, seeds, fuzzy iterations to the tolerance, merging, labels."""
    w = written(O.sample_weights(layered(spark, sf), 0.3), "weighted")
    first = w.where("first_layer").select("disc_id", "nx", "ny", "nz")
    layer = O.angular_dbscan(first, 12.0, O.density_minimum(first.count()))
    start = [tuple(r[c] for c in O.C) for r in O.centres_of(layer).orderBy("label").collect()]
    start = [c[:3] for c in O.with_seeds(start, [_unit(s) for s in SEEDS], 10.0)]
    rows = w.select("disc_id", "nx", "ny", "nz", "alpha")
    member, centres = O.fuzzy_c_means(rows, start)
    centres, _ = O.merge_centres(centres, O.centre_masses(member, len(centres)), 15.0, 10)
    m, _ = O.fuzzy_c_means(rows, centres, rounds=1)
    return O.assigned(m, 0.3)
