"""Point and orientation views over the tables, and SQL texts for the other engine.

``pts``: four known planes with uniform noise, a pure function of event_id. ``orient``: unit normals of the first three
embedding components. ``vox``: pts with voxel keys.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import upper
from ..operators.voxels import with_voxels
from ..tables import table

SIZE, LEAST = 2.0, 30

_X = "CAST((event_id * 7919 + 104729) % 10007 AS DOUBLE) / 1.0007e4 * 1e1 - 5e0"
_Y = "CAST((event_id * 6101 + 15485863) % 10009 AS DOUBLE) / 1.0009e4 * 1e1 - 5e0"
_E = "(CAST((event_id * 3571 + 32452843) % 10037 AS DOUBLE) / 1.0037e4 - 5e-1) * 4e-2"
_Z = "CASE fam WHEN 0 THEN 2e-1 * x + 1e-1 * y + 1e0 WHEN 1 THEN -5e-1 * x + 3e-1 * y + 2e1 WHEN 2 THEN 1.5e0 * x - 2e-1 * y + 6e1 ELSE 5e-2 * y + 1e2 END + e"

PTS = f"""pts AS (SELECT point_id, fam, x, y, {_Z} AS z, value, user_id, event_type
 FROM (SELECT event_id AS point_id, CAST(event_id % 4 AS INT) AS fam, {_X} AS x, {_Y} AS y, {_E} AS e, value, user_id, event_type FROM events))"""


def pts(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "events").selectExpr("event_id AS point_id", "CAST(event_id % 4 AS INT) AS fam", f"{_X} AS x", f"{_Y} AS y", f"{_E} AS e", "value", "user_id", "event_type")
    return base.withColumn("z", F.expr(_Z)).select("point_id", "fam", "x", "y", "z", "value", "user_id", "event_type")


def vox(spark: SparkSession, folder: str, size: float = SIZE) -> DataFrame:
    return with_voxels(pts(spark, folder), size)


def vox_sql(size: float = SIZE, src: str = "pts", name: str = "vox") -> str:
    return f"""{name} AS (SELECT p.*, lx, ly, lz, CAST(floor((x - lx) / {size}) AS BIGINT) AS vx, CAST(floor((y - ly) / {size}) AS BIGINT) AS vy, CAST(floor((z - lz) / {size}) AS BIGINT) AS vz
 FROM {src} p, (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts))"""


ORIENT = """orient AS (SELECT vec_id AS disc_id, label, s * x / n AS nx, s * y / n AS ny, s * z / n AS nz FROM
 (SELECT vec_id, label, x, y, z, sqrt(x * x + y * y + z * z) AS n,
   CASE WHEN z > 1e-9 THEN 1e0 WHEN z < -1e-9 THEN -1e0 WHEN y > 1e-9 THEN 1e0 WHEN y < -1e-9 THEN -1e0 WHEN x < -1e-9 THEN -1e0 ELSE 1e0 END AS s
  FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)))"""


def orient(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("disc_id"), "label", *(F.element_at("embedding", k + 1).cast("double").alias(c) for k, c in enumerate("xyz")))
    flipped = upper(tuple(F.col(c) for c in "xyz"))
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return v.select("disc_id", "label", *((f / n).alias(c) for f, c in zip(flipped, ("nx", "ny", "nz"))))


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def q6(text: str) -> str:
    return f"(round({text}, 6) + 0.0)"


def fit_sql(src: str, keys: list[str], name: str = "fit", weight: str = "1e0") -> str:
    """CTEs that end in ``name``: keys, n, cx.., a, b, c, d, rmse, l0, l1, l2, curvature; the least-squares plane by key."""
    k = ", ".join(keys)
    by = f"GROUP BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    on = " AND ".join(f"s.{x} = m.{x}" for x in keys) or "true"
    pick = lambda c: f"CASE WHEN s1 = best THEN {c}1 WHEN s2 = best THEN {c}2 ELSE {c}3 END"
    n = name
    return f"""{n}_c AS (SELECT {lead}sum({weight} * x) / sum({weight}) AS cx, sum({weight} * y) / sum({weight}) AS cy, sum({weight} * z) / sum({weight}) AS cz, count(*) AS n FROM {src} {by}),
 {n}_d AS (SELECT {", ".join(f"s.{x} AS {x}" for x in keys)}{", " if keys else ""}{weight.replace("weight", "s.weight")} AS w, x - cx AS dx, y - cy AS dy, z - cz AS dz, cx, cy, cz, m.n AS n FROM {src} s JOIN {n}_c m ON {on}),
 {n}_m AS (SELECT {lead}min(n) AS n, min(cx) AS cx, min(cy) AS cy, min(cz) AS cz, sum(w*dx*dx)/sum(w) AS xx, sum(w*dy*dy)/sum(w) AS yy, sum(w*dz*dz)/sum(w) AS zz, sum(w*dx*dy)/sum(w) AS xy, sum(w*dx*dz)/sum(w) AS xz, sum(w*dy*dz)/sum(w) AS yz FROM {n}_d {by}),
 {n}_q AS (SELECT *, (xx+yy+zz)/3e0 AS q, xx+yy+zz AS tr FROM {n}_m),
 {n}_p AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2e0*(xy*xy+xz*xz+yz*yz))/6e0) AS p,
   (xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz) AS det FROM {n}_q),
 {n}_h AS (SELECT *, acos(greatest(-1e0, least(1e0, coalesce(det / nullif(2e0*p*p*p, 0e0), 1e0)))) / 3e0 AS phi FROM {n}_p),
 {n}_l AS (SELECT *, q + 2e0*p*cos(phi + 2e0*pi()/3e0) AS l0, q + 2e0*p*cos(phi) AS l2 FROM {n}_h),
 {n}_x AS (SELECT *, 3e0*q - l0 - l2 AS l1,
   xy*yz - xz*(yy-l0) AS x1, xz*xy - (xx-l0)*yz AS y1, (xx-l0)*(yy-l0) - xy*xy AS z1,
   xy*(zz-l0) - xz*yz AS x2, xz*xz - (xx-l0)*(zz-l0) AS y2, (xx-l0)*yz - xy*xz AS z2,
   (yy-l0)*(zz-l0) - yz*yz AS x3, yz*xz - xy*(zz-l0) AS y3, xy*yz - (yy-l0)*xz AS z3 FROM {n}_l),
 {n}_s AS (SELECT *, x1*x1+y1*y1+z1*z1 AS s1, x2*x2+y2*y2+z2*z2 AS s2, x3*x3+y3*y3+z3*z3 AS s3 FROM {n}_x),
 {n}_b AS (SELECT *, greatest(s1, s2, s3) AS best FROM {n}_s),
 {n}_v AS (SELECT *, CASE WHEN n >= 3 AND best > 1e-24*tr*tr*tr*tr THEN sqrt(best) END AS len, {pick("x")} AS ux, {pick("y")} AS uy, {pick("z")} AS uz FROM {n}_b),
 {n}_u AS (SELECT *, ux/len AS ua, uy/len AS ub, uz/len AS uc FROM {n}_v),
 {n}_f AS (SELECT *, CASE WHEN uc > 1e-9 THEN 1e0 WHEN uc < -1e-9 THEN -1e0 WHEN ub > 1e-9 THEN 1e0 WHEN ub < -1e-9 THEN -1e0 WHEN ua < -1e-9 THEN -1e0 ELSE 1e0 END AS sg FROM {n}_u),
 {n} AS (SELECT {lead}n, cx, cy, cz, sg*ua AS a, sg*ub AS b, sg*uc AS c, -(sg*ua*cx + sg*ub*cy + sg*uc*cz) AS d,
   CASE WHEN ua IS NOT NULL THEN sqrt(greatest(0e0, l0)) END AS rmse, l0, l1, l2, l0/(tr + 1e-12) AS curvature FROM {n}_f)"""


def dip_sql(p: str = "") -> str:
    return f"degrees(atan2(sqrt({p}a*{p}a+{p}b*{p}b), abs({p}c)))"


def dir_sql(p: str = "") -> str:
    return f"(CASE WHEN degrees(atan2({p}a, {p}b)) < 0 THEN degrees(atan2({p}a, {p}b)) + 360e0 ELSE degrees(atan2({p}a, {p}b)) END)"
