"""Queries on converters, synthetic clouds, colours, names and box adjacency."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.planefit import plane_fit
from ..operators import growth, neighbours, orientation_clusters, ransac, runs
from ..sources import converters, synthetic
from ..tables import table
from .fixtures import PTS, pts, q6, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH g AS (SELECT p AS plane_id, s * 0.05e0 AS s, t * 0.05e0 AS y FROM (SELECT unnest(range(2)) AS p), (SELECT unnest(range(21)) AS s), (SELECT unnest(range(21)) AS t))
 SELECT CAST(plane_id AS INTEGER) AS plane_id, {q6('s * cos(radians(70e0) * plane_id)')} AS x, {q6('y')} AS y, {q6('s * sin(radians(70e0) * plane_id)')} AS z FROM g""")
def synthetic_book(spark, sf):
    return synthetic.book(spark, 70.0).select("plane_id", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query("SELECT unnest([0, 30, 70, 90]) AS angle, unnest([0e0, 30e0, 70e0, 90e0]) AS found")
def book_angles(spark, sf):
    """The fitted angle of the leaves of books of known angles."""
    out = None
    for angle in (0, 30, 70, 90):
        f = plane_fit(synthetic.book(spark, float(angle)), ["plane_id"]).select("plane_id", "a", "b", "c")
        both = f.where("plane_id = 0").select(*(F.col(c).alias(f"p{c}") for c in "abc")).crossJoin(f.where("plane_id = 1"))  # one row each
        one = both.select(F.lit(angle).alias("angle"), (F.round(V.plane_angle(V.vec("pa", "pb", "pc"), V.vec("a", "b", "c")), 4) + 0.0).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id AS point_id, CAST(CASE WHEN user_id % 10 = 3 THEN 255 WHEN event_type = 'click' THEN 10 ELSE 160 END AS INTEGER) AS r, CAST(CASE WHEN user_id % 10 = 3 THEN 0 WHEN event_type = 'click' THEN 20 ELSE 160 END AS INTEGER) AS g FROM events")
def set_painting(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), "user_id", "event_type")
    sets = [e.where("event_type = 'click'"), e.where("user_id % 10 = 3")]
    return converters.painted(e.select("point_id"), "point_id", sets, [(10, 20, 30), (255, 0, 0)]).select("point_id", "r", "g")


@query("SELECT DISTINCT user_id, CAST(user_id * 3 + 1 AS BIGINT) AS parsed, CAST(-1 AS BIGINT) AS bad FROM events")
def integer_like_text(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    text = F.concat((F.col("user_id") * 3 + 1).cast("string"), F.lit(".0"))
    return u.select("user_id", converters.as_integer(text).alias("parsed"), F.coalesce(converters.as_integer(F.concat(F.lit("x"), F.col("user_id").cast("string"))), F.lit(-1).cast("long")).alias("bad"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)', 1) AS number FROM pages")
def name_parsing(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@query(f"""WITH {PTS} SELECT point_id, {', '.join(f"CAST(least(255e0, greatest(0e0, round_even({c} * 37.5e0, 0))) AS INTEGER) AS {n}" for c, n in zip("xyz", "rgb"))} FROM pts""")
def clipped_colors(spark, sf):
    return pts(spark, sf).select("point_id", *(V.byte(F.col(c) * 37.5).alias(n) for c, n in zip("xyz", "rgb")))


_WHEEL = """hue AS (SELECT DISTINCT user_id, (user_id * 0.61803398875e0) % 1e0 AS h FROM events), sec AS (SELECT *, floor(h * 6e0) AS k, h * 6e0 - floor(h * 6e0) AS f FROM hue),
 leg AS (SELECT user_id, CAST(k AS INTEGER) % 6 AS k, 0.95e0 * (1e0 - 0.65e0) AS low, 0.95e0 * (1e0 - 0.65e0 * f) AS fall, 0.95e0 * (1e0 - 0.65e0 * (1e0 - f)) AS rise, 0.95e0 AS top FROM sec)"""
_WAYS = {"r": "top fall low low rise top", "g": "rise top top fall low low", "b": "low low rise top top fall"}


@query(f"WITH {_WHEEL} SELECT user_id, " + ", ".join(f"CAST(floor(255e0 * CASE k {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(ways.split()))} END) AS INTEGER) AS {c}" for c, ways in _WAYS.items()) + " FROM leg")
def golden_colors(spark, sf):
    red, green, blue = V.golden_colour(F.col("user_id"))
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", red.alias("r"), green.alias("g"), blue.alias("b"))


@query()
def seeded_colors(spark, sf):
    return converters.seeded_colours(table(spark, sf, "events").select("user_id").distinct(), "user_id")


_BOX = "bx AS (SELECT DISTINCT CAST(floor((x + 5) / 2.5) AS BIGINT) AS i, CAST(floor((y + 5) / 2.5) AS BIGINT) AS j, CAST(fam AS BIGINT) AS k FROM pts)"
_BOXES = f"{_BOX}, b2 AS (SELECT i * 1000 + j * 10 + k AS id, 2*i AS x0, 2*i + 1 AS x1, 2*j AS y0, 2*j + 1 + (i % 2) AS y1, k AS z0, k AS z1 FROM bx)"


@query(f"""WITH {PTS}, {_BOXES} SELECT a.id AS a, b.id AS b, 'x' AS axis FROM b2 a JOIN b2 b ON a.x1 + 1 = b.x0 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1
 UNION ALL SELECT a.id, b.id, 'y' FROM b2 a JOIN b2 b ON a.y1 + 1 = b.y0 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1
 UNION ALL SELECT a.id, b.id, 'z' FROM b2 a JOIN b2 b ON a.z1 + 1 = b.z0 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def face_neighbor_boxes(spark, sf):
    """Boxes of two sizes that touch with a face."""
    b = pts(spark, sf).select(F.floor((F.col("x") + 5) / 2.5).cast("long").alias("i"), F.floor((F.col("y") + 5) / 2.5).cast("long").alias("j"), F.col("fam").cast("long").alias("k")).distinct()
    boxes = b.selectExpr("i * 1000 + j * 10 + k AS id", "2 * i AS x0", "2 * i + 1 AS x1", "2 * j AS y0", "2 * j + 1 + (i % 2) AS y1", "k AS z0", "k AS z1")
    return neighbours.face_neighbours(boxes)


@query("SELECT count(*) AS n, min(value) AS min_value, max(value) AS max_value, count(*) FILTER (WHERE value IS NULL) AS missing_value, min(user_id) AS min_user_id, max(user_id) AS max_user_id, count(*) FILTER (WHERE user_id IS NULL) AS missing_user_id FROM events")
def range_profile(spark, sf):
    return converters.range_profile(table(spark, sf, "events"), ["value", "user_id"])


@query("WITH k AS (SELECT user_id AS js, length(event_type) AS cl, min(event_id) AS f FROM events GROUP BY ALL), d AS (SELECT js, cl, row_number() OVER (ORDER BY f) AS disc_id FROM k) SELECT event_id AS point_id, disc_id, CAST((37 * disc_id + 59) % 256 AS INTEGER) AS dr FROM events JOIN d ON js = user_id AND cl = length(event_type)")
def header_alias_projection(spark, sf):
    """Set export rows under their canonical names, with dense ids by first appearance and colours."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").cast("double").alias("js"), F.length("event_type").cast("double").alias("cl"))
    return converters.set_points(e).select(F.col("line_no").alias("point_id"), F.col("disc_id").cast("long").alias("disc_id"), F.col("DR").alias("dr"))


@query(f"""WITH RECURSIVE {PTS}, lc(n, x) AS (SELECT 0, CAST((1 * 48271 + 11) % 2147483647 AS BIGINT) UNION ALL SELECT n + 1, (x * 48271 + 11) % 2147483647 FROM lc WHERE n < 999),
 sm AS (SELECT * FROM (SELECT point_id, row_number() OVER (ORDER BY h, point_id) - 1 AS place FROM (SELECT point_id, (((point_id % 1000003) * 48271 + 7919) % 2147483647 * 69621 + 1) % 2147483647 AS h FROM pts)) WHERE place < 1000),
 ln AS (SELECT count(*) AS t FROM sm), pr AS (SELECT a.n // 2 AS pair_id, a.x % t AS i, b.x % t AS j, t FROM lc a JOIN lc b ON b.n = a.n + 1 AND a.n % 2 = 0, ln)
 SELECT CAST(pair_id AS INTEGER) AS pair_id, s.point_id AS i, u.point_id AS j FROM pr JOIN sm s ON s.place = i JOIN sm u ON u.place = CASE WHEN j = i THEN (j + 1) % t ELSE j END""")
def random_pairs(spark, sf):
    return growth.random_pairs(pts(spark, sf), 500)


@query()
def detector_runs(spark, sf):
    """Two detectors with one clusterer over one cloud."""
    p = pts(spark, sf).select("point_id", "x", "y", "z")

    def labels(segments, eps, least):
        o = segments.select(F.col("plane_id").cast("long").alias("disc_id"), F.col("a").alias("nx"), F.col("b").alias("ny"), F.col("c").alias("nz"))
        return orientation_clusters.angular_dbscan(o, eps, least)

    found = runs.runs(
        p, [runs.Step("fine", ransac.detect_planes, {"threshold": 0.03, "least": 200, "tries": 1000}), runs.Step("coarse", ransac.detect_planes, {"threshold": 0.1, "least": 200, "tries": 1000})],
        [runs.Step("density", labels, {"eps": 10.0, "least": 1})],
    )
    out = None
    for r in found:
        one = r.labels.select(F.lit(r.run_id).alias("run_id"), "disc_id", "label")
        out = one if out is None else out.unionByName(one)
    return out
