"""Queries behind rose diagrams, stereonets, distributions and reports; tables, labels, tiles and exports."""

import sys

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.planefit import plane_fit
from ..operators import blocks, growth, polygons, ransac, voxels
from ..operators import statistics as S
from ..shared_store import written
from ..tables import table
from .fixtures import ORIENT, PTS, SIZE, fit_sql, orient, pts, q6, r6, vox, vox_sql
from .orientation_queries import _OD, with_dips

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_OD} SELECT CAST(least(35, floor(dip_dir / 1e1)) AS INTEGER) AS bin, count(*) AS count, least(35, floor(dip_dir / 1e1)) * 1e1 + 5e0 AS center FROM od GROUP BY 1, 3")
def rose_histogram(spark, sf):
    return S.fixed_histogram(with_dips(orient(spark, sf)), "dip_dir", 10.0, 0.0, 360.0).select("bin", "count", "center")


@query(f"WITH {_OD} SELECT label, CAST(least(35, floor(dip_dir / 1e1)) AS INTEGER) AS bin, count(*) AS count, least(35, floor(dip_dir / 1e1)) * 1e1 + 5e0 AS center FROM od GROUP BY 1, 2, 4")
def rose_compare(spark, sf):
    return S.fixed_histogram(with_dips(orient(spark, sf)), "dip_dir", 10.0, 0.0, 360.0, ["label"]).select("label", "bin", "count", "center")


@query(f"""WITH {_OD} SELECT label, {q6('avg(dip_dir)')} AS mean_dir_arith, {q6('CASE WHEN degrees(atan2(sum(sin(radians(dip_dir))), sum(cos(radians(dip_dir))))) < 0 THEN degrees(atan2(sum(sin(radians(dip_dir))), sum(cos(radians(dip_dir))))) + 360e0 ELSE degrees(atan2(sum(sin(radians(dip_dir))), sum(cos(radians(dip_dir))))) END')} AS mean_dir_circular, count(*) AS n FROM od GROUP BY label""")
def mean_directions(spark, sf):
    return S.mean_direction(with_dips(orient(spark, sf)), "dip_dir", ["label"]).select("label", r6("mean_dir_arith").alias("mean_dir_arith"), r6("mean_dir_circular").alias("mean_dir_circular"), "n")


_PRICE = "v AS (SELECT p_retailprice AS v FROM part WHERE p_retailprice > 0)"


@query(f"""WITH {_PRICE}, e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v), b AS (SELECT CAST(least(19, floor((v - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, lo, hi, n FROM v, e)
 SELECT bin, count(*) AS count, {q6('min(lo) + bin * (min(hi) - min(lo)) / 20')} AS left_edge, {q6('min(lo) + (bin + 1) * (min(hi) - min(lo)) / 20')} AS right_edge, {q6('count(*) / (min(n) * (min(hi) - min(lo)) / 20)')} AS density FROM b GROUP BY bin""")
def equal_width_histogram(spark, sf):
    h = S.equal_width_histogram(table(spark, sf, "part").where("p_retailprice > 0"), "p_retailprice", 20)
    return h.select("bin", "count", *(r6(c).alias(c) for c in ("left_edge", "right_edge", "density")))


@query(f"""WITH {_PRICE}, e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v), g AS (SELECT unnest(range(50)) AS i)
 SELECT CAST(i AS INTEGER) AS i, {q6('min(lo + i * (hi - lo) / 49)')} AS at, {q6('sum(exp(-0.5e0 * ((lo + i * (hi - lo) / 49 - v) / h) * ((lo + i * (hi - lo) / 49 - v) / h)) / (h * sqrt(2 * pi()) * n)) * 1e3')} AS density FROM v, e, g GROUP BY i""")
def kde_1d(spark, sf):
    k = S.kde_1d(table(spark, sf, "part").where("p_retailprice > 0").withColumn("v", F.col("p_retailprice")), "v", 50)
    return k.select("i", r6("at").alias("at"), r6(F.col("density") * 1e3).alias("density"))


@query(f"""WITH {_OD}, g AS (SELECT a * 2 AS dir, d AS dip0 FROM (SELECT unnest(range(180)) AS a), (SELECT unnest(range(91)) AS d)),
 s AS (SELECT dir, dip0, sum(exp(-(pow(cos(radians(dir)) - cos(radians(dip_dir)), 2) + pow(sin(radians(dir)) - sin(radians(dip_dir)), 2) + pow((dip0 - dip) / 90e0, 2)) / (2e0 * 0.22e0 * 0.22e0))) AS s FROM od, g GROUP BY dir, dip0)
 SELECT CAST(dir AS INTEGER) AS dir, CAST(dip0 AS INTEGER) AS dip, {q6('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS density FROM s""")
def kde_sphere_grid(spark, sf):
    return S.kde_sphere(with_dips(orient(spark, sf)), "dip_dir", "dip", 0.22, 2, 1).select("dir", "dip", r6("density").alias("density"))


_PAIRS = f"""{ORIENT}, pr AS (SELECT a.disc_id AS i, b.disc_id AS j, a.label = b.label AS same_plane, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz AS dot, sqrt((a.nx-b.nx)*(a.nx-b.nx)+(a.ny-b.ny)*(a.ny-b.ny)+(a.nz-b.nz)*(a.nz-b.nz)) AS diff_norm
 FROM orient a JOIN orient b ON b.disc_id = (a.disc_id * 7 + 3) % (SELECT max(disc_id) + 1 FROM orient) AND a.disc_id <> b.disc_id), pa AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, dot)))) AS angle_deg FROM pr)"""


def pairs(spark, sf):
    """Every plane with one other, by arithmetic on the ids."""
    o = orient(spark, sf)
    top = o.agg((F.max("disc_id") + 1).alias("_top"))
    a = o.crossJoin(F.broadcast(top)).select(F.col("disc_id").alias("i"), F.col("label").alias("la"), *(F.col(c).alias(f"a{c}") for c in ("nx", "ny", "nz")), ((F.col("disc_id") * 7 + 3) % F.col("_top")).alias("j"))
    b = o.select(F.col("disc_id").alias("j"), F.col("label").alias("lb"), *(F.col(c).alias(f"b{c}") for c in ("nx", "ny", "nz")))
    p = a.join(b, "j").where("i <> j")
    u, v = V.vec("anx", "any", "anz"), V.vec("bnx", "bny", "bnz")
    return p.select("i", "j", (F.col("la") == F.col("lb")).alias("same_plane"), V.dot(u, v).alias("dot"), V.direction_angle(u, v).alias("angle_deg"), V.length(V.minus(u, v)).alias("diff_norm"))


@query(f"WITH {_PAIRS} SELECT i, j, same_plane, {q6('dot')} AS dot, {q6('angle_deg')} AS angle_deg, {q6('diff_norm')} AS diff_norm FROM pa")
def pair_metrics(spark, sf):
    return pairs(spark, sf).select("i", "j", "same_plane", *(r6(c).alias(c) for c in ("dot", "angle_deg", "diff_norm")))


def _stats(v):
    return f"count({v}) AS n, {q6(f'avg({v})')} AS mean, {q6(f'stddev_pop({v})')} AS std, {q6(f'quantile_cont({v}, 0.5)')} AS median, {q6(f'quantile_cont({v}, 0.05)')} AS p05, {q6(f'quantile_cont({v}, 0.25)')} AS p25, {q6(f'quantile_cont({v}, 0.75)')} AS p75, {q6(f'quantile_cont({v}, 0.95)')} AS p95, {q6(f'min({v})')} AS min, {q6(f'max({v})')} AS max"


@query(f"WITH {_PAIRS}, l AS (SELECT 'angle_deg' AS metric, CAST(same_plane AS VARCHAR) AS grp, angle_deg AS v FROM pa UNION ALL SELECT 'dot', CAST(same_plane AS VARCHAR), dot FROM pa), g AS (SELECT * FROM l UNION ALL SELECT metric, 'all', v FROM l) SELECT metric, grp, {_stats('v')} FROM g GROUP BY metric, grp")
def pair_summary_groups(spark, sf):
    s = S.summary(pairs(spark, sf), ["angle_deg", "dot"], "same_plane")
    return s.select("metric", "grp", "n", *(r6(c).alias(c) for c in s.columns[3:]))


@query(f"WITH {_PAIRS}, r AS (SELECT {q6('angle_deg')} AS value FROM pa) SELECT DISTINCT value, {q6('cume_dist() OVER (ORDER BY value)')} AS cdf FROM r")
def cdf_pairs(spark, sf):
    return S.ecdf(pairs(spark, sf).select(r6("angle_deg").alias("a")), "a").select("value", r6("cdf").alias("cdf"))


_AB = "a AS (SELECT value AS v FROM events WHERE event_type = 'click'), b AS (SELECT value AS v FROM events WHERE event_type <> 'click')"


def two_samples(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.col("value"))
    return e.where("event_type = 'click'"), e.where("event_type <> 'click'")


@query(f"""WITH {_AB}, q AS (SELECT list_transform(range(101), lambda k: k / 100.0) AS p), qa AS (SELECT quantile_cont(v, {[k / 100 for k in range(101)]}) AS x FROM a), qb AS (SELECT quantile_cont(v, {[k / 100 for k in range(101)]}) AS y FROM b),
 u AS (SELECT unnest(x) AS x, unnest(y) AS y FROM qa, qb) SELECT {q6('sum(abs(x - y)) / 101')} AS distance FROM u""")
def wasserstein_quantile(spark, sf):
    return S.wasserstein_quantile(*two_samples(spark, sf), "v").select(r6("distance").alias("distance"))


@query(f"""WITH {_AB}, u AS (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM u GROUP BY v),
 c AS (SELECT sum(x) OVER (ORDER BY v) / (SELECT count(*) FROM a) - sum(y) OVER (ORDER BY v) / (SELECT count(*) FROM b) AS gap FROM g) SELECT {q6('max(abs(gap))')} AS distance FROM c""")
def ks_statistic(spark, sf):
    return S.ks_statistic(*two_samples(spark, sf), "v").select(r6("distance").alias("distance"))


@query(f"""WITH {_AB}, h AS (SELECT least(24, floor(v / 2e1)) AS bin, 1e0 / (SELECT count(*) FROM a WHERE v BETWEEN 0 AND 500) AS p, 0e0 AS q FROM a WHERE v BETWEEN 0 AND 500
 UNION ALL SELECT least(24, floor(v / 2e1)), 0e0, 1e0 / (SELECT count(*) FROM b WHERE v BETWEEN 0 AND 500) FROM b WHERE v BETWEEN 0 AND 500), g AS (SELECT bin, sum(p) AS p, sum(q) AS q FROM h GROUP BY bin) SELECT {q6('sum(abs(p - q))')} AS distance FROM g""")
def hist_l1(spark, sf):
    return S.histogram_l1(*two_samples(spark, sf), "v", 0.0, 500.0, 25).select(r6("distance").alias("distance"))


@query(f"WITH {PTS} SELECT point_id, {', '.join(f'CAST(({a} * point_id + {b}) % 256 AS INTEGER) AS {c}' for c, a, b in (('r', 37, 59), ('g', 17, 97), ('b', 73, 23)))} FROM pts")
def id_colors(spark, sf):
    r, g, b = V.id_colour(F.col("point_id"))
    return pts(spark, sf).select("point_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT user_id, " + ", ".join(f"CASE WHEN user_id = 0 THEN 0 ELSE CAST(CAST('0x' || substr(md5(CAST(user_id - 1 AS VARCHAR)), {k}, 2) AS BIGINT) AS INTEGER) END AS {c}" for c, k in (("r", 1), ("g", 3), ("b", 5))) + " FROM (SELECT DISTINCT user_id FROM events)")
def md5_colors(spark, sf):
    r, g, b = V.text_colour((F.col("user_id") - 1).cast("string"))
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", r.alias("r"), g.alias("g"), b.alias("b"))


_LABELS = "lb AS (SELECT user_id, CAST(user_id % 12 AS BIGINT) AS cluster_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0)"


def labels(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().where("user_id % 5 <> 0").withColumn("cluster_id", F.col("user_id") % 12)


@query(f"WITH {_LABELS} SELECT event_id AS point_id, e.user_id AS facet_id, coalesce(cluster_id, -1) AS cluster_id FROM events e LEFT JOIN lb USING (user_id)")
def facet_label_join(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), "user_id")
    return e.join(labels(spark, sf), "user_id", "left").select("point_id", F.col("user_id").alias("facet_id"), F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"))


@query(f"WITH {_LABELS} SELECT user_id AS facet_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY user_id) AS sub_number FROM lb")
def subcluster_number(spark, sf):
    w = Window.partitionBy("cluster_id").orderBy("user_id")
    return labels(spark, sf).select(F.col("user_id").alias("facet_id"), "cluster_id", F.row_number().over(w).cast("long").alias("sub_number"))


@query("WITH k AS (SELECT user_id, event_type, min(event_id) AS first_row FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (ORDER BY first_row) AS dense_id FROM k")
def dense_id_first_seen(spark, sf):
    from ..operators.orientation_clusters import ranked

    k = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_row"))
    return ranked(k, [F.col("first_row")], "first_row", "dense_id").select("user_id", "event_type", F.col("dense_id").cast("long").alias("dense_id"))


@query("SELECT user_id, count(*) AS n, CASE WHEN user_id = (SELECT max(user_id) FROM events) THEN -1 ELSE user_id END AS disc_id FROM events GROUP BY user_id")
def merged_ids_last_background(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("user_id").alias("_last"))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(last))
    return n.select("user_id", "n", F.when(F.col("user_id") == F.col("_last"), F.lit(-1)).otherwise(F.col("user_id")).alias("disc_id"))


_TILE, _OVER, _STEP = 4.0, 0.1, 3.6
_TL = f"""{PTS}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM pts),
 {', '.join(f"a{c}0 AS (SELECT point_id, {c} - l{c} AS o, unnest(range(CAST(greatest(0, floor(({c} - l{c} - {_TILE}) / {_STEP})) AS BIGINT), CAST(floor(({c} - l{c}) / {_STEP}) AS BIGINT) + 1)) AS t{c} FROM pts, b), a{c} AS (SELECT point_id, t{c} FROM a{c}0 WHERE o >= t{c} * {_STEP} AND o < t{c} * {_STEP} + {_TILE})" for c in 'xyz')},
 tl AS (SELECT tx, ty, tz, pts.*, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS lab FROM pts JOIN ax USING (point_id) JOIN ay USING (point_id) JOIN az USING (point_id))"""


def tiled(spark, sf):
    p = pts(spark, sf).withColumn("lab", F.when(F.col("user_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    return voxels.tiles(p, _TILE, _OVER)


@query(f"WITH {_TL} SELECT point_id, tx, ty, tz FROM tl")
def tile_assign(spark, sf):
    return tiled(spark, sf).select("point_id", "tx", "ty", "tz")


@query(f"WITH {_TL} SELECT tx, ty, tz, count(*) AS n_points, count(*) FILTER (WHERE lab <> -1) AS n_structure, count(DISTINCT CASE WHEN lab <> -1 THEN lab END) AS n_instances, {q6('count(*) FILTER (WHERE lab <> -1) / count(*)')} AS frac_pts, {q6('count(*) * 36e0 / 1048576e0')} AS mem_mb FROM tl GROUP BY ALL")
def tile_block_report(spark, sf):
    r = voxels.tile_report(tiled(spark, sf), "lab")
    return r.select("tx", "ty", "tz", "n_points", "n_structure", "n_instances", r6("frac_pts").alias("frac_pts"), r6("mem_mb").alias("mem_mb"))


_H1 = "((point_id % 1000003) * 48271 + 12345) % 2147483647"


@query(f"""WITH {_TL}, s AS (SELECT *, {_H1} AS h, lab <> -1 AS onn, count(*) OVER (PARTITION BY tx, ty, tz) AS n, count(*) FILTER (WHERE lab <> -1) OVER (PARTITION BY tx, ty, tz) AS non FROM tl),
 q AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz, onn ORDER BY h, point_id) AS rk, CASE WHEN n <= 150 THEN n WHEN onn THEN floor(150e0 * non / n) ELSE 150 - floor(150e0 * non / n) END AS quota FROM s WHERE n >= 20)
 SELECT point_id, tx, ty, tz FROM q WHERE rk <= quota""")
def tile_stratified_sample(spark, sf):
    return voxels.stratified_sample(tiled(spark, sf), "point_id", "lab", 150, 20).select("point_id", "tx", "ty", "tz")


@query(f"WITH {_TL} SELECT point_id, tx, ty, tz, {', '.join(f'{q6(f'{c} - avg({c}) OVER (PARTITION BY tx, ty, tz)')} AS {c}0' for c in 'xyz')}, CASE WHEN lab <> -1 THEN 1 ELSE 0 END AS segment, lab AS instance FROM tl")
def tile_centred_sample(spark, sf):
    s = voxels.centred_sample(tiled(spark, sf), "lab")
    return s.select("point_id", "tx", "ty", "tz", *(r6(f"{c}0").alias(f"{c}0") for c in "xyz"), "segment", F.col("instance").cast("long").alias("instance"))


@query(f"""WITH {_TL}, bl AS (SELECT tx, ty, tz, count(*) AS n FROM tl GROUP BY ALL), h AS (SELECT *, ((((((tx % 1000003) * 48271 + 12345) % 2147483647) * 31 + (ty % 1000003) * 48271 + 12346) % 2147483647) * 31 + (tz % 1000003) * 48271 + 12347) % 2147483647 AS h FROM bl),
 r AS (SELECT *, row_number() OVER (ORDER BY h, tx, ty, tz) AS rk, count(*) OVER () AS t FROM h) SELECT tx, ty, tz, n, CASE WHEN rk <= floor(t * 0.7e0) THEN 'train' WHEN rk > t - floor(t * 0.1e0) THEN 'test' ELSE 'val' END AS split FROM r""")
def tile_split(spark, sf):
    blocks = tiled(spark, sf).groupBy("tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n"))
    return voxels.split(blocks, ["tx", "ty", "tz"], (0.7, 0.2, 0.1)).select("tx", "ty", "tz", "n", "split")


#: A ring of eight corners for every family of events, by arithmetic: a stretched octagon.
_RING = """rg AS (SELECT fam, k, (2e0 + fam) * cos(k * pi() / 4e0) AS u, (1e0 + fam / 2e0) * sin(k * pi() / 4e0) AS v FROM (SELECT unnest(range(8)) AS k), (SELECT DISTINCT CAST(event_id % 4 AS INTEGER) AS fam FROM events))"""


def rings(spark, sf):
    fam = table(spark, sf, "events").select((F.col("event_id") % 4).cast("int").alias("fam")).distinct()
    r = fam.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("k", F.col("k").cast("long"))
    angle = F.col("k") * F.pi() / 4.0
    return r.withColumns({"u": (2.0 + F.col("fam")) * F.cos(angle), "v": (1.0 + F.col("fam") / 2.0) * F.sin(angle)})


@query(f"WITH {_RING}, e AS (SELECT fam, u, v, coalesce(lead(u) OVER w, first(u) OVER w0) AS u2, coalesce(lead(v) OVER w, first(v) OVER w0) AS v2 FROM rg WINDOW w AS (PARTITION BY fam ORDER BY k), w0 AS (PARTITION BY fam ORDER BY k)) SELECT fam, count(*) AS corners, {q6('abs(sum(u * v2 - u2 * v)) / 2')} AS area FROM e GROUP BY fam")
def shoelace_area(spark, sf):
    return polygons.areas(rings(spark, sf), "fam").select("fam", "corners", r6("area").alias("area"))


@query(f"WITH {_RING} SELECT a.fam, {q6('max(sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v)))')} AS trace FROM rg a JOIN rg b ON a.fam = b.fam AND a.k < b.k GROUP BY a.fam")
def polygon_diameter(spark, sf):
    return polygons.diameters(rings(spark, sf), "fam").select("fam", r6("trace").alias("trace"))


@query(f"""WITH {_RING}, ln AS (SELECT unnest(range(1, 6)) AS line), pos AS (SELECT fam, line, -(2e0 + fam) + line / 6e0 * 2e0 * (2e0 + fam) AS x0 FROM ln, (SELECT DISTINCT fam FROM rg)),
 e AS (SELECT a.fam, a.u, a.v, b.u AS u2, b.v AS v2 FROM rg a JOIN rg b ON a.fam = b.fam AND b.k = (a.k + 1) % 8),
 c AS (SELECT pos.fam, line, v + (x0 - u) / nullif(u2 - u, 0e0) * (v2 - v) AS y FROM pos JOIN e ON e.fam = pos.fam AND (x0 - u) / nullif(u2 - u, 0e0) BETWEEN 0 AND 1)
 SELECT fam, CAST(CASE WHEN line <= 3 THEN least(line, 6 - line) ELSE 6 - line END AS INTEGER) AS line, {q6('max(y) - min(y)')} AS width FROM c GROUP BY fam, c.line""")
def polygon_widths(spark, sf):
    """Widths at five lines; lines are named from the nearer end, so the direction of the trace does not matter."""
    r = rings(spark, sf)
    w = polygons.widths(r, "fam", r.select("fam", F.lit(5).alias("lines")).distinct())
    return w.select("fam", F.least(F.col("line"), 6 - F.col("line")).cast("int").alias("line"), r6("width").alias("width"))


@query(f"WITH {_RING} SELECT fam, CAST(k AS BIGINT) AS k, CAST(0 AS BIGINT) AS v0, CAST(k + 1 AS BIGINT) AS v1, CAST((k + 1) % 8 + 1 AS BIGINT) AS v2 FROM rg")
def triangle_fan(spark, sf):
    return polygons.triangle_fan(rings(spark, sf), "fam")


_SEG = f"{PTS}, {fit_sql('pts', ['fam'])}"


def segment_tables(spark, sf):
    p = pts(spark, sf).withColumn("disc_id", F.col("fam").cast("long"))
    segs = plane_fit(p, ["disc_id"]).withColumn("seg_id", F.lit(0).cast("long"))
    members = p.select("point_id", "disc_id", F.lit(0).cast("long").alias("seg_id"), (F.col("disc_id") % 2).alias("cluster_id"))
    return p, segs, members


@query(f"""WITH {_SEG} SELECT point_id, {q6('x')} AS X, CAST(p.fam AS BIGINT) AS disc, CAST(p.fam % 2 AS BIGINT) AS clus, CAST((37 * p.fam + 59) % 256 AS INTEGER) AS dr, {q6('f.a')} AS pa, {q6('f.d')} AS pd, {q6('rmse')} AS rms, {q6('abs(f.a*x + f.b*y + f.c*z + f.d)')} AS dist FROM pts p JOIN fit f USING (fam)""")
def points_table(spark, sf):
    """The canonical point table (a part of its columns, and the point's id)."""
    from ..sources.sinks import point_table

    p, segs, members = segment_tables(spark, sf)
    t = point_table(members, p.withColumn("curvature", F.col("point_id").cast("double")), segs)
    return t.select(F.col("Curvature").cast("long").alias("point_id"), r6("X").alias("X"), F.col("Discontinuity_id").alias("disc"), F.col("Cluster_id").alias("clus"), F.col("DR").alias("dr"), r6("A_plane").alias("pa"), r6("D_plane").alias("pd"), r6("RMS").alias("rms"), r6("DistToPlane").alias("dist"))


@query(f"""WITH {_SEG}, {_RING}, ar AS (SELECT a.fam, abs(sum(a.u * b.v - b.u * a.v)) / 2 AS area FROM rg a JOIN rg b ON a.fam = b.fam AND b.k = (a.k + 1) % 8 GROUP BY a.fam),
 tr AS (SELECT a.fam, max(sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v))) AS trace FROM rg a JOIN rg b ON a.fam = b.fam AND a.k < b.k GROUP BY a.fam)
 SELECT CAST(fit.fam AS BIGINT) AS disc, CAST(fit.fam % 2 AS BIGINT) AS clus, {q6('degrees(atan2(sqrt(a*a+b*b), abs(c)))')} AS dip, n AS points, {q6('rmse')} AS mean_rms, {q6('area')} AS area, {q6('trace')} AS trace FROM fit JOIN ar USING (fam) JOIN tr USING (fam)""")
def discontinuity_table(spark, sf):
    from ..sources.sinks import discontinuity_table as write

    p, segs, members = segment_tables(spark, sf)
    ring = rings(spark, sf)
    geometry = polygons.areas(ring, "fam").join(polygons.diameters(ring, "fam"), "fam").select(F.col("fam").cast("long").alias("disc_id"), "area", "trace")
    t = write(members, segs, segs, geometry)
    return t.select(F.col("Discontinuity_id").alias("disc"), F.col("Cluster_id").alias("clus"), r6("Dip").alias("dip"), F.col("PointsNumber").alias("points"), r6("MeanRMS").alias("mean_rms"), r6("Area").alias("area"), r6("TraceLength").alias("trace"))


@query(f"WITH RECURSIVE {PTS}, nb AS (SELECT a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 4e-2), deg AS (SELECT a, count(*) AS d FROM nb GROUP BY a) SELECT CAST(d >= 5 AS INTEGER) AS core, count(*) AS n FROM deg GROUP BY 1")
def dbscan_core_counts(spark, sf):
    return blocks.core_flags(pts(spark, sf), 0.2, 5).groupBy(F.col("core").cast("int").alias("core")).agg(F.count(F.lit(1)).alias("n"))


# --- without SQL: iterative, seeded or order-dependent


@query()
def euclidean_dbscan(spark, sf):
    return growth.dbscan(pts(spark, sf).select("point_id", "x", "y", "z"), 0.25, 6).select("point_id", "label")


def with_normals(spark, sf):
    from .point_queries import K, point_normals

    p = pts(spark, sf).select("point_id", "fam", "x", "y", "z")
    return written(p.join(point_normals(p, K), "point_id"), "normals")


@query()
def region_growing(spark, sf):
    return growth.region_growing(with_normals(spark, sf), 0.15, 20.0, 30)


@query()
def ordered_regions(spark, sf):
    """Regions grown from seeds in order, each against its seed's plane, within blocks of ten units."""
    from ..operators.voxels import KEY

    return growth.ordered_regions(voxels.with_voxels(with_normals(spark, sf), 10.0), KEY, 0.15, 20.0, 30)


@query()
def sequential_ransac(spark, sf):
    planes, _ = ransac.detect_planes(pts(spark, sf).select("point_id", "x", "y", "z"), 0.05, 100, 1000)
    return planes.select("plane_id", "n", *(r6(c).alias(c) for c in "abcd"))


@query()
def weighted_ransac(spark, sf):
    p = S.curvature_weights(pts(spark, sf), "value", 0.5, 0.05)
    planes, _ = ransac.detect_planes(p, 0.05, 100, 100, weight="weight", sigma=0.02)
    return planes.select("plane_id", "n", *(r6(c).alias(c) for c in "abcd"))


@query()
def voxel_ransac_patches(spark, sf):
    return ransac.voxel_patches(vox(spark, sf), 0.03, 20, rounds=2, thickness=0.04, cell=0.6)


@query()
def convex_hull(spark, sf):
    p = pts(spark, sf)
    return polygons.hulls(polygons.plane_coordinates(p, "fam", plane_fit(p, ["fam"])), "fam").select("fam", "k", r6("u").alias("u"), r6("v").alias("v"))


@query()
def hull_filtered_points(spark, sf):
    """Points of every family inside the hull of its plane's largest part, and the plane fitted to them again."""
    p = pts(spark, sf).select("point_id", "fam", "x", "y", "z")
    kept = written(polygons.hull_filter(p, "fam", plane_fit(p, ["fam"]), 1.0), "hull-points")
    return plane_fit(p.join(kept, ["fam", "point_id"]), ["fam"]).select("fam", "n", *(r6(c).alias(c) for c in "abcd"))


@query()
def patch_geometry(spark, sf):
    g = polygons.patch_geometry(pts(spark, sf), "fam")
    return g.select("fam", "points", *(r6(c).alias(c) for c in ("rmse", "area", "trace", "mean_width")))


@query()
def shape_distributions(spark, sf):
    return growth.shape_distributions(pts(spark, sf), 0.5, 64, 10)


@query()
def mst_orientation(spark, sf):
    return growth.oriented_normals(with_normals(spark, sf).where("nx IS NOT NULL"), 6)


@query()
def curvature_search(spark, sf):
    p = with_normals(spark, sf).where("nx IS NOT NULL")
    return growth.curvature_search(p, 0.05, 0.01, 0.4, 6)


@query()
def moe_growth(spark, sf):
    """Points of the planes that grow from the peaks of the votes, over coplanar voxels and octants and single points beside them."""
    from ..operators import hemisphere
    from ..operators.neighbours import face_neighbours
    from ..operators.voxels import KEY, bounds, voxel_name
    from .point_queries import moe_accumulator, moe_leaves

    p = written(with_normals(spark, sf), "points")
    keyed, low = voxels.with_voxels(p, SIZE), bounds(p)
    leaves = written(moe_leaves(spark, sf).withColumn("leaf", voxel_name("octant")), "leaves")
    own = hemisphere.leaf_points(keyed, SIZE, low, leaves).withColumn("leaf", voxel_name("octant"))
    # A voxel is two cells wide, an octant one.
    ends = {}
    for k, c in enumerate("xyz"):
        half = F.when(F.col("octant") < 0, F.lit(0)).otherwise(F.shiftright("octant", k).bitwiseAND(1))
        ends |= {f"{c}0": 2 * F.col(f"v{c}") + half, f"{c}1": 2 * F.col(f"v{c}") + F.when(F.col("octant") < 0, 1).otherwise(half)}
    beside = face_neighbours(leaves.withColumn("id", F.col("leaf")).withColumns(ends).select("id", *ends))
    adjacency = beside.select("a", "b").unionByName(beside.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    top = hemisphere.peaks(moe_accumulator(spark, sf), 0.1)
    phi, theta = F.radians(F.col("phi").cast("double")), F.radians(F.col("theta").cast("double"))
    m = {"mx": F.sin(phi) * F.cos(theta), "my": F.sin(phi) * F.sin(theta), "mz": F.cos(phi)}
    peaks = top.withColumns(m).select((F.col("phi") * 360 + F.col("theta")).alias("peak"), *m, "votes")
    return growth.leaf_growth(leaves, adjacency, own.select("point_id", "leaf", "x", "y", "z", "nx", "ny", "nz"), peaks, 5.0, 20.0, 20.0, 0.5)


#: Edge patches, as in the reference's preset: the least points left for a search and in a patch, the limits of distance and angle.
EDGE_START, EDGE_LEAST, EDGE_DISTANCE, EDGE_ANGLE = 31, 26, 0.2, 10.0


@query()
def voxel_patch_pipeline(spark, sf):
    """Seeds by a plane search in every voxel, edge patches of what is left, growth over touching voxels, merging of patches:
    points with their discontinuity.

    Edge patches are searched until a voxel's rest has none; each joins the best seed of a touching voxel or is a seed itself."""
    from ..operators import patches
    from ..operators.voxels import KEY

    p = written(voxels.with_voxels(with_normals(spark, sf), SIZE), "points")
    name = voxels.voxel_name()
    first = written(ransac.voxel_patches(p, 0.03, 30, 1000), "first-planes").where("patch >= 0").select("point_id", name.alias("seed"))
    found = p.join(first, "point_id")
    seeds = written(plane_fit(found, ["seed", *KEY]), "seeds")
    rest = p.join(first, "point_id", "left_anti")
    edges = written(ransac.voxel_patches(rest, 0.03, EDGE_LEAST, 500, seed=2, rounds=sys.maxsize, start=EDGE_START), "edge-patches").where("patch >= 0").select("point_id", "patch")
    edge = written(rest.join(edges, "point_id"), "edge-points")
    fits = written(plane_fit(edge, [*KEY, "patch"]), "edge-fits")
    matched = patches.edge_matches(fits, seeds, edge, EDGE_DISTANCE, EDGE_ANGLE, ("patch",))
    to = F.when(F.col("merge_reason") == "merged", F.concat_ws("_", "nx", "ny", "nz")).otherwise(F.concat(F.lit("edge:"), voxels.voxel_name("patch")))  # after all seeds of voxels
    matched = written(matched.select(*KEY, "patch", to.alias("seed"), (F.col("merge_reason") != "merged").alias("new")), "edge-matches")
    new = fits.join(matched.where("new"), [*KEY, "patch"])
    s = seeds.select("seed", *KEY, *"abcd").unionByName(new.select("seed", *KEY, *"abcd"))
    joined = edge.join(matched, [*KEY, "patch"])
    members = written(found.select("point_id", "seed", "x", "y", "z").unionByName(joined.select("point_id", "seed", "x", "y", "z")), "seed-members")
    free = p.where("nx IS NOT NULL").join(members, "point_id", "left_anti")
    grown = patches.grow_seeds(s, free.select("point_id", *KEY, "x", "y", "z", "nx", "ny", "nz"), members.select("seed", "x", "y", "z"), patches.growth_levels(0.1, 30.0, 0.02, 5.0), 5.0)
    every = written(members.select("point_id", "seed").unionByName(grown), "members")
    own = p.join(every, "point_id")
    fits = written(plane_fit(own, ["seed"]).withColumnRenamed("seed", "patch"), "fits")
    near = patches.patch_adjacency(own.withColumnRenamed("seed", "patch"))
    disc = patches.merge_patches(fits, near, 10.0, 0.5, SIZE)
    return every.join(disc.withColumnRenamed("patch", "seed"), "seed").select("point_id", "seed", "disc")
