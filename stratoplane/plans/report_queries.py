"""Queries behind reports: validity filters, cluster boxes, quantile bins, panels of distributions, point stereonets, signed planes."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.planefit import plane_fit, unbiased
from ..operators import orientation_clusters as O
from ..operators import blocks, patches, polygons, voxels
from ..operators import statistics as S
from ..operators.orientation_clusters import ranked
from ..operators.voxels import KEY
from ..sources import converters
from ..tables import table
from .fixtures import LEAST, ORIENT, PTS, dip_sql, fit_sql, orient, pts, q6, r6, vox, vox_sql
from .orientation_queries import _CS, _DIP, _DIR, clustered
from .plot_queries import _TL, tiled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MEASURED = "ms AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL ELSE value - 20e0 END AS dip, CAST((event_id * 7) % 400 AS DOUBLE) AS dip_dir FROM events)"


def measured(spark, sf):
    e = table(spark, sf, "events")
    return e.selectExpr("event_id", "CASE WHEN event_id % 11 = 0 THEN double('NaN') WHEN event_id % 13 = 0 THEN NULL ELSE value - 20e0 END AS dip", "CAST((event_id * 7) % 400 AS DOUBLE) AS dip_dir")


@query(f"WITH {_MEASURED} SELECT event_id FROM ms WHERE NOT isnan(dip) AND dip BETWEEN 0 AND 90 AND dip_dir >= 0 AND dip_dir < 360")
def valid_orientations(spark, sf):
    return measured(spark, sf).where(V.valid_orientation(F.col("dip"), F.col("dip_dir"))).select("event_id")


@query(f"WITH {_MEASURED} SELECT event_id, {q6('dip')} AS area FROM ms WHERE NOT isnan(dip) AND dip > 0 AND isfinite(dip)")
def positive_measures(spark, sf):
    return measured(spark, sf).where(V.positive(F.col("dip"))).select("event_id", r6("dip").alias("area"))


@query("SELECT user_id AS cluster_id, count(*) AS members, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS BIGINT) AS show_id FROM events GROUP BY user_id ORDER BY members DESC, user_id LIMIT 20")
def largest_clusters(spark, sf):
    """The twenty clusters with most members, numbered by size."""
    return S.largest(table(spark, sf, "events").groupBy(F.col("user_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("members")), "members", "cluster_id", 20)


@query(f"WITH {PTS}, {vox_sql()}, {fit_sql('vox', KEY)} SELECT vx, vy, vz, n, {q6('l1 * n / (n - 1)')} AS l1, {q6('l2 * n / (n - 1)')} AS l2, {q6('sqrt(greatest(0e0, l0) * n / (n - 1))')} AS rmse FROM fit WHERE n >= {LEAST}")
def plane_fit_unbiased(spark, sf):
    """Plane fits with the covariance of a sample (N - 1)."""
    f = unbiased(plane_fit(vox(spark, sf), KEY)).where(F.col("n") >= LEAST)
    return f.select(*KEY, "n", r6("l1").alias("l1"), r6("l2").alias("l2"), r6("rmse").alias("rmse"))


_EDGES = ", ".join(f"{k / 16}" for k in range(17))


@query(f"SELECT CAST(k AS INTEGER) AS k, {q6('e[k + 1]')} AS edge FROM (SELECT quantile_cont(value, [{_EDGES}]) AS e FROM events), (SELECT unnest(range(17)) AS k)")
def quantile_edges(spark, sf):
    """Bin edges at equal shares of the values."""
    return S.quantile_edges(table(spark, sf, "events"), "value", 16).select("k", r6("edge").alias("edge"))


@query("SELECT event_id, CASE WHEN l >= 1e-8 THEN " + q6("x / l") + " END AS nx, CASE WHEN l >= 1e-8 THEN " + q6("z / l") + " END AS nz, l >= 1e-8 AS valid FROM (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM (SELECT event_id, CAST(event_id % 3 AS DOUBLE) AS x, CAST(event_id % 5 AS DOUBLE) AS y, CAST(event_id % 2 AS DOUBLE) AS z FROM events))")
def unit_normals(spark, sf):
    """Unit vectors, and whether a vector is long enough to have a direction."""
    e = table(spark, sf, "events").selectExpr("event_id", "double(event_id % 3) AS x", "double(event_id % 5) AS y", "double(event_id % 2) AS z")
    n = V.unit(V.vec("x", "y", "z"))
    return e.select("event_id", r6(n[0]).alias("nx"), r6(n[2]).alias("nz"), n[0].isNotNull().alias("valid"))


@query(f"WITH {PTS} SELECT CAST(user_id % 12 AS BIGINT) AS label, count(*) AS n, {', '.join(f'{q6(f'{f}({c})')} AS {f}_{c}' for c in 'xyz' for f in ('avg', 'min', 'max'))} FROM pts GROUP BY 1")
def cluster_boxes(spark, sf):
    """Members, centroid and box of every cluster."""
    b = voxels.boxes(pts(spark, sf).withColumn("label", F.col("user_id") % 12), ["label"])
    return b.select("label", "n", *(r6(f"{f}_{c}").alias(f"{f}_{c}") for c in "xyz" for f in ("avg", "min", "max")))


@query(f"""WITH {_TL}, bl AS (SELECT tx, ty, tz, count(*) AS n FROM tl GROUP BY ALL), h AS (SELECT *, ((((((tx % 1000003) * 48271 + 12345) % 2147483647) * 31 + (ty % 1000003) * 48271 + 12346) % 2147483647) * 31 + (tz % 1000003) * 48271 + 12347) % 2147483647 AS h FROM bl),
 r AS (SELECT *, row_number() OVER (ORDER BY h, tx, ty, tz) AS rk, count(*) OVER () AS t FROM h), s AS (SELECT *, CASE WHEN rk <= floor(t * 0.7e0) THEN 'train' WHEN rk > t - floor(t * 0.1e0) THEN 'test' ELSE 'val' END AS split FROM r)
 SELECT split, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS points, {q6('avg(n)')} AS mean_points, min(n) AS min_points, max(n) AS max_points FROM s GROUP BY split""")
def split_summary(spark, sf):
    blocks = tiled(spark, sf).groupBy("tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n"))
    s = voxels.split_summary(voxels.split(blocks, ["tx", "ty", "tz"], (0.7, 0.2, 0.1)), "n")
    return s.select("split", "blocks", "points", r6("mean_points").alias("mean_points"), "min_points", "max_points")


_TURNED = "pn AS (SELECT *, CASE WHEN fam % 2 = 0 THEN 1e0 ELSE -1e0 END * sin(point_id) * 2e-1 AS nx, cos(point_id) * 2e-1 AS ny, CASE WHEN fam % 2 = 0 THEN 1e0 ELSE -1e0 END AS nz FROM pts)"


def turned(spark, sf):
    side = F.when(F.col("fam") % 2 == 0, 1.0).otherwise(-1.0)
    return pts(spark, sf).withColumns({"nx": side * F.sin("point_id") * 0.2, "ny": F.cos("point_id") * 0.2, "nz": side})


@query(f"""WITH {PTS}, {_TURNED}, {fit_sql('pts', ['fam'])}, mn AS (SELECT fam, avg(nx) AS ax, avg(ny) AS ay, avg(nz) AS az FROM pn GROUP BY fam),
 sg AS (SELECT fit.*, CASE WHEN a*ax + b*ay + c*az < 0 THEN -1e0 ELSE 1e0 END AS s FROM fit JOIN mn USING (fam))
 SELECT fam, {', '.join(f'{q6(f's * {c}')} AS {c}' for c in 'abcd')}, {q6(dip_sql())} AS dip FROM sg""")
def signed_planes(spark, sf):
    """Planes turned to the side of their points' mean normal; dips from the normals as fitted."""
    p = turned(spark, sf)
    f = plane_fit(p, ["fam"]).withColumn("dip", V.dip(V.vec("a", "b", "c")))
    return patches.oriented(f, p, "fam").select("fam", *(r6(c).alias(c) for c in "abcd"), r6("dip").alias("dip"))


_COS = math.cos(math.radians(75.0))


@query(f"""WITH {PTS}, {_TURNED}, lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts), vn AS (SELECT pn.*, CAST(floor((x - lx) / 2.0) AS BIGINT) AS vx, CAST(floor((y - ly) / 2.0) AS BIGINT) AS vy, CAST(floor((z - lz) / 2.0) AS BIGINT) AS vz FROM pn, lo), {fit_sql('vn', KEY)}
 SELECT vx, vy, vz, count(*) FILTER (WHERE near) AS near, count(*) FILTER (WHERE near AND abs(fit.a*v.nx + fit.b*v.ny + fit.c*v.nz) / sqrt(v.nx*v.nx + v.ny*v.ny + v.nz*v.nz) >= {_COS!r}) AS inliers
 FROM (SELECT v.*, abs(f.a*v.x + f.b*v.y + f.c*v.z + f.d) <= 3e-2 AS near FROM vn v JOIN fit f USING (vx, vy, vz) WHERE f.n >= {LEAST}) v JOIN fit USING (vx, vy, vz) GROUP BY ALL""")
def normal_compatible_inliers(spark, sf):
    """Points near their voxel's plane, and those of them whose normals agree with it."""
    v = voxels.with_voxels(turned(spark, sf), 2.0)
    f = plane_fit(v, KEY).where(F.col("n") >= LEAST).select(*KEY, *"abcd")
    n, own = V.vec("a", "b", "c"), V.vec("nx", "ny", "nz")
    j = v.join(f, KEY).withColumns({"near": F.abs(V.plane_distance(n, F.col("d"), V.vec("x", "y", "z"))) <= 0.03, "alike": V.compatible(n, own, _COS)})
    return j.groupBy(*KEY).agg(F.count_if("near").alias("near"), F.count_if(F.col("near") & F.col("alike")).alias("inliers"))


_CHORD = 2.0 * math.sin(math.radians(20.0) / 2.0)
_PTDB = f"""{ORIENT}, lim AS (SELECT greatest(30, CAST(floor(0.003e0 * count(*)) AS BIGINT)) AS least FROM orient), nb AS (SELECT a.disc_id AS a, b.disc_id AS b FROM orient a JOIN orient b ON (a.nx-b.nx)*(a.nx-b.nx) + (a.ny-b.ny)*(a.ny-b.ny) + (a.nz-b.nz)*(a.nz-b.nz) <= {_CHORD * _CHORD!r}),
 core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= (SELECT least FROM lim)), e AS (SELECT a AS x, b AS y FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), cc AS (SELECT x AS id, min(y) AS c FROM r GROUP BY x),
 nu AS (SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS label FROM cc), bo AS (SELECT nb.a AS id, min(label) AS label FROM nb JOIN nu ON nu.id = nb.b GROUP BY nb.a),
 db AS (SELECT o.*, CAST(coalesce(nu.label, bo.label, -1) AS BIGINT) AS cl FROM orient o LEFT JOIN nu ON nu.id = o.disc_id LEFT JOIN bo ON bo.id = o.disc_id)"""


def point_clusters(spark, sf):
    o = orient(spark, sf).drop("label")
    least = max(30, int(0.003 * o.count()))
    return blocks.density_clusters(o, "disc_id", ("nx", "ny", "nz"), blocks.Radius(_CHORD), least)


@query(f"WITH RECURSIVE {_PTDB} SELECT disc_id, cl AS label FROM db")
def point_density_clusters(spark, sf):
    """Density clusters of point normals as directions, by chords."""
    return point_clusters(spark, sf).select("disc_id", "label")


@query(f"""WITH RECURSIVE {_PTDB}, su AS (SELECT cl, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, count(*) AS members FROM db WHERE cl >= 0 GROUP BY cl), ct AS (SELECT cl, members, sx / sqrt(sx*sx+sy*sy+sz*sz) AS nx, sy / sqrt(sx*sx+sy*sy+sz*sz) AS ny, sz / sqrt(sx*sx+sy*sy+sz*sz) AS nz FROM su),
 ra AS (SELECT db.cl, max(degrees(acos(greatest(-1e0, least(1e0, db.nx*ct.nx + db.ny*ct.ny + db.nz*ct.nz))))) AS radius FROM db JOIN ct USING (cl) GROUP BY db.cl)
 SELECT cl AS label, members, {q6(_DIP)} AS dip, {q6(_DIR)} AS dip_dir, {q6('tan(radians(' + _DIP + ') / 2e0)')} AS stereo_r, {q6('radius')} AS radius, CAST(row_number() OVER (ORDER BY members DESC, cl) - 1 AS BIGINT) AS show_id FROM ct JOIN ra USING (cl) ORDER BY members DESC, cl LIMIT 20""")
def point_stereonet(spark, sf):
    """The largest clusters of point normals with their place in the net and the radius of their circle."""
    c = point_clusters(spark, sf)
    centres = O.centres_of(c)
    both = c.where("label >= 0").join(centres.select("label", *O.C), "label")
    radius = both.groupBy("label").agg(F.max(V.direction_angle(V.vec("nx", "ny", "nz"), V.vec(*O.C))).alias("radius"))
    n = V.vec(*O.C)
    top = S.largest(centres.join(radius, "label"), "members", "label", 20)
    return top.select("label", "members", r6(V.dip(n)).alias("dip"), r6(V.dip_direction(n)).alias("dip_dir"), r6(F.tan(F.radians(V.dip(n)) / 2.0)).alias("stereo_r"), r6("radius").alias("radius"), "show_id")


_USERS = """us AS (SELECT user_id, avg(value) / 1e3 AS roughness FROM events GROUP BY user_id), ur AS (SELECT user_id, k, (1e0 + user_id % 17) * cos(k * pi() / 4e0) AS u, (5e-1 + (user_id % 5) / 2e0) * sin(k * pi() / 4e0) AS v FROM us, (SELECT unnest(range(8)) AS k)),
 ar AS (SELECT a.user_id, abs(sum(a.u * b.v - b.u * a.v)) / 2 AS v FROM ur a JOIN ur b ON a.user_id = b.user_id AND b.k = (a.k + 1) % 8 GROUP BY a.user_id),
 tr AS (SELECT a.user_id, max(sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v))) AS v FROM ur a JOIN ur b ON a.user_id = b.user_id AND a.k < b.k GROUP BY a.user_id),
 me AS (SELECT 'area' AS metric, round(v, 9) AS v FROM ar UNION ALL SELECT 'trace', round(v, 9) FROM tr UNION ALL SELECT 'roughness', round(roughness, 9) FROM us WHERE roughness > 0 AND roughness <= 1)"""


def user_measures(spark, sf):
    """metric, v: areas and traces of an octagon for each user, and a roughness between 0 and 1."""
    users = table(spark, sf, "events").groupBy("user_id").agg((F.avg("value") / 1e3).alias("roughness"))
    ring = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    angle = F.col("k") * F.pi() / 4.0
    ring = ring.withColumns({"k": F.col("k").cast("long"), "u": (1.0 + F.col("user_id") % 17) * F.cos(angle), "v": (0.5 + (F.col("user_id") % 5) / 2.0) * F.sin(angle)})
    out = polygons.areas(ring, "user_id").select(F.lit("area").alias("metric"), F.round("area", 9).alias("v"))
    out = out.unionByName(polygons.diameters(ring, "user_id").select(F.lit("trace").alias("metric"), F.round("trace", 9).alias("v")))
    return out.unionByName(users.where("roughness > 0 AND roughness <= 1").select(F.lit("roughness").alias("metric"), F.round("roughness", 9).alias("v")))


@query(f"""WITH {_USERS}, e AS (SELECT metric, min(v) AS lo, max(v) AS hi, count(*) AS n FROM me GROUP BY metric), b AS (SELECT metric, CAST(least(11, floor((v - lo) / ((hi - lo) / 12))) AS INTEGER) AS bin, lo, hi, n FROM me JOIN e USING (metric)),
 c AS (SELECT metric, bin, count(*) AS count, min(lo) AS lo, min(hi) AS hi FROM b GROUP BY metric, bin)
 SELECT metric, bin, count, {q6('lo + bin * (hi - lo) / 12')} AS left_edge, {q6('1.1e0 * max(count) OVER ()')} AS y_limit FROM c""")
def distribution_panels(spark, sf):
    """Three panels of histograms, of areas, traces and roughness, with one limit of counts for all."""
    m = user_measures(spark, sf)
    out = None
    for metric in ("area", "trace", "roughness"):
        h = S.equal_width_histogram(m.where(F.col("metric") == metric), "v", 12).select(F.lit(metric).alias("metric"), "bin", "count", "left_edge")
        out = h if out is None else out.unionByName(h)
    top = out.agg((F.max("count") * 1.1).alias("y_limit"))
    return out.crossJoin(F.broadcast(top)).select("metric", "bin", "count", r6("left_edge").alias("left_edge"), r6("y_limit").alias("y_limit"))  # one row


@query(f"""WITH {_USERS}, e AS (SELECT metric, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM me GROUP BY metric), g AS (SELECT unnest(range(40)) AS i)
 SELECT metric, CAST(i AS INTEGER) AS i, {q6('min(lo + i * (hi - lo) / 39)')} AS at, {q6('sum(exp(-0.5e0 * ((lo + i * (hi - lo) / 39 - v) / h) * ((lo + i * (hi - lo) / 39 - v) / h)) / (h * sqrt(2 * pi()) * n))')} AS density FROM me JOIN e USING (metric), g GROUP BY metric, i""")
def distribution_curves(spark, sf):
    """Densities of areas, traces and roughness."""
    m = user_measures(spark, sf)
    out = None
    for metric in ("area", "trace", "roughness"):
        k = S.kde_1d(m.where(F.col("metric") == metric), "v", 40).select(F.lit(metric).alias("metric"), "i", "at", "density")
        out = k if out is None else out.unionByName(k)
    return out.select("metric", "i", r6("at").alias("at"), r6("density").alias("density"))


@query(f"""WITH RECURSIVE {_CS}, {PTS}, {fit_sql('pts', [])}
 SELECT 'cluster ' || cl AS name, (round({_DIP}, 4) + 0.0) AS dip, (round(({_DIR} + 270e0) - 360e0 * floor(({_DIR} + 270e0) / 360e0), 4) + 0.0) AS strike FROM ct
 UNION ALL SELECT 'slope', (round({dip_sql()}, 4) + 0.0), (round((d0 + 270e0) - 360e0 * floor((d0 + 270e0) / 360e0), 4) + 0.0) FROM (SELECT *, CASE WHEN degrees(atan2(a, b)) < 0 THEN degrees(atan2(a, b)) + 360e0 ELSE degrees(atan2(a, b)) END AS d0 FROM fit)""")
def slope_against_clusters(spark, sf):
    """Strike and dip of every cluster's centre and of the whole cloud."""
    c = O.centres_of(clustered(spark, sf)).select(F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("name"), *(F.col(m).alias(x) for m, x in zip(O.C, "abc")))
    s = plane_fit(pts(spark, sf), []).select(F.lit("slope").alias("name"), "a", "b", "c")
    n = V.vec("a", "b", "c")
    strike = F.pmod(V.dip_direction(n) + 270.0, F.lit(360.0))
    return c.unionByName(s).select("name", (F.round(V.dip(n), 4) + F.lit(0.0)).alias("dip"), (F.round(strike, 4) + F.lit(0.0)).alias("strike"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]*$', '\1') AS base_name, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS folder FROM pages")
def base_names(spark, sf):
    """File names without folder and suffix."""
    return table(spark, sf, "pages").select("page_id", converters.base_name(F.col("url")).alias("base_name"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("folder"))


@query(f"WITH {PTS}, {vox_sql()}, {fit_sql('vox', KEY)} SELECT vx, vy, vz, CAST(row_number() OVER (ORDER BY round(rmse, 9), vx, vy, vz) AS BIGINT) AS place FROM fit WHERE n >= {LEAST} AND a IS NOT NULL")
def patches_by_error(spark, sf):
    f = plane_fit(vox(spark, sf), KEY).where((F.col("n") >= LEAST) & F.col("a").isNotNull()).select(*KEY, F.round("rmse", 9).alias("error"))
    return ranked(f, [F.col("error"), *(F.col(k) for k in KEY)], "error", "place").select(*KEY, F.col("place").cast("long").alias("place"))


@query("SELECT user_id AS disc_id, array_to_string(list_sort(list_distinct(list(i))), ' ') AS points FROM (SELECT user_id, event_id % 50 AS i FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id % 50 FROM events WHERE value > 50) GROUP BY user_id")
def united_segments(spark, sf):
    """The points of all segments of a discontinuity, each once, in order."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("disc_id"), (F.col("event_id") % 50).alias("i"), "event_type", "value")
    u = patches.united([e.where("event_type = 'click'"), e.where("value > 50")], "disc_id", "i")
    return u.select("disc_id", F.array_join("i", " ").alias("points"))


@query(f"""WITH {_USERS}, e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, CAST(greatest(10, least(50, floor(sqrt(count(*))))) AS INTEGER) AS k FROM me WHERE metric <> 'roughness'),
 b AS (SELECT CAST(least(k - 1, floor((v - lo) / ((hi - lo) / k))) AS INTEGER) AS bin, lo, hi, k FROM me, e WHERE metric <> 'roughness')
 SELECT bin, count(*) AS count, {q6('min(lo) + bin * (min(hi) - min(lo)) / min(k)')} AS left_edge FROM b GROUP BY bin""")
def adaptive_histogram(spark, sf):
    """Equal bins whose number grows with the root of the number of values."""
    from ..shared_store import written

    v = written(user_measures(spark, sf).where("metric <> 'roughness'"), "measures")
    return S.equal_width_histogram(v, "v", S.adaptive_bins(v.count())).select("bin", "count", r6("left_edge").alias("left_edge"))


@query("SELECT event_id AS disc_id, CASE WHEN value > 50 THEN value - 50 ELSE CAST(user_id AS DOUBLE) END AS trace FROM events")
def traces_or_longest_segments(spark, sf):
    """A discontinuity's trace, or its longest segment's where it has none."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("disc_id"), (F.col("value") - 50).alias("trace"), F.col("user_id").cast("double").alias("longest"))
    return e.select("disc_id", O.trace_or_longest_segment(e, "trace", "longest").alias("trace"))
