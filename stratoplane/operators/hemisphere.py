"""Orientation voting on the upper hemisphere: coplanarity of voxels and of the octants of the others, Gaussian votes, peaks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planefit import plane_fit
from ..functions.vectors import dip, octant, vec
from ..shared_store import written
from .voxels import KEY


def coplanar(fits: DataFrame, ratio: float, most_error: float) -> Column:
    """Middle eigenvalue above ratio times the smallest, and a mean squared error below the limit."""
    return F.coalesce((F.col("l1") > ratio * F.col("l0")) & (F.col("l0") < most_error), F.lit(False))


def coplanarity(keyed: DataFrame, ratio: float, most_error: float, least: int, keys: list[str] = KEY) -> DataFrame:
    """Every voxel with its fit and kind: cop (coplanar), non, or spa (at most ``least`` points)."""
    fits = plane_fit(keyed, keys)
    return fits.withColumn("kind", F.when(F.col("n") <= least, "spa").when(coplanar(fits, ratio, most_error), "cop").otherwise("non"))


def two_levels(keyed: DataFrame, size: float, low: DataFrame, ratio: float, most_error: float, least: int, least_octant: int) -> DataFrame:
    """The leaves of the two-level grid: voxels that are coplanar or sparse (octant -1), and the octants of all others, each with its
    edge ``size``, fit and kind."""
    whole = written(coplanarity(keyed, ratio, most_error, least), "voxel-kinds")
    parted = octants(keyed.join(whole.where("kind = 'non'").select(*KEY), KEY, "left_semi"), size, low)
    parts = coplanarity(parted, ratio, most_error, least_octant, [*KEY, "octant"]).withColumn("size", F.lit(size / 2.0))
    first = whole.where("kind <> 'non'").withColumns({"octant": F.lit(-1), "size": F.lit(float(size))})
    return first.unionByName(parts)


def leaf_points(keyed: DataFrame, size: float, low: DataFrame, leaves: DataFrame) -> DataFrame:
    """Points with the octant of their leaf: -1 where the whole voxel is one."""
    split = leaves.where("octant >= 0").select(*KEY).distinct().withColumn("_split", F.lit(True))
    both = octants(keyed, size, low).join(split, KEY, "left")
    return both.withColumn("octant", F.when(F.col("_split"), F.col("octant")).otherwise(-1)).drop("_split")


def octants(keyed: DataFrame, size: float, low: DataFrame) -> DataFrame:
    """Points with the octant (0 to 7) of their voxel; low is the one-row origin (min_x, min_y, min_z)."""
    p = keyed.crossJoin(F.broadcast(low.select("min_x", "min_y", "min_z")))
    middle = tuple(F.col(f"min_{c}") + (F.col(f"v{c}") + 0.5) * size for c in "xyz")
    return p.withColumn("octant", octant(tuple(F.col(c) for c in "xyz"), middle)).drop("min_x", "min_y", "min_z")


def votes(leaves: DataFrame, ratio: float, extent: Column, total: Column) -> DataFrame:
    """phi (angle from the vertical, 0..90), theta (azimuth of the normal from the x axis, 0..359) and the sum of Gaussian votes of
    coplanar leaves.

    sigma = max(0.5, 5 * ratio / (l1 / l0)); the window reaches max(1, round(sigma)) cells, wraps round in theta and ends at the
    pole and the equator; theta is cut to whole degrees, phi rounded. A vote weighs half its leaf's share of the extent (the
    longest side of the cloud's box), half its share of points."""
    n = vec("a", "b", "c")
    azimuth = F.degrees(F.atan2(n[1], n[0]))
    azimuth = F.when((F.abs(n[0]) < 1e-12) & (F.abs(n[1]) < 1e-12), 0.0).when(azimuth < 0, azimuth + 360.0).otherwise(azimuth)
    sigma = F.greatest(F.lit(0.5), 5.0 * ratio / F.when(F.col("l0") > 0, F.col("l1") / F.col("l0")).otherwise(float(ratio)))
    weight = 0.5 * F.col("size") / extent + 0.5 * F.col("n") / total
    base = leaves.where("kind = 'cop'").withColumns({"_s": sigma, "_w": weight, "_phi": F.least(F.lit(90), F.rint(dip(n)).cast("int")), "_theta": F.floor(azimuth).cast("int") % 360})
    reach = F.greatest(F.lit(1), F.rint("_s").cast("int"))
    cells = base.withColumn("_dp", F.explode(F.sequence(-reach, reach))).withColumn("_dt", F.explode(F.sequence(-reach, reach)))
    cells = cells.withColumns({"phi": F.col("_phi") + F.col("_dp"), "theta": F.pmod(F.col("_theta") + F.col("_dt"), F.lit(360))}).where("phi BETWEEN 0 AND 90")
    vote = F.col("_w") * F.exp(-(F.col("_dp") * F.col("_dp") + F.col("_dt") * F.col("_dt")) / (2.0 * F.col("_s") * F.col("_s")))
    return cells.groupBy("phi", "theta").agg(F.sum(vote).alias("votes"))


def peaks(accumulator: DataFrame, least: float = 0.0) -> DataFrame:
    """Cells not below any of their eight neighbours (theta circular, phi clamped) and above ``least``.

    The accumulator has at most 91 x 360 cells; its neighbours are an equi-join after repeating each cell nine times."""
    around = accumulator.withColumn("_p", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("_t", F.explode(F.sequence(F.lit(-1), F.lit(1)))).where("NOT (_p = 0 AND _t = 0)")
    near = around.select((F.col("phi") + F.col("_p")).alias("phi"), F.pmod(F.col("theta") + F.col("_t"), F.lit(360)).alias("theta"), F.col("votes").alias("_v"))
    best = near.groupBy("phi", "theta").agg(F.max("_v").alias("_best"))
    return accumulator.join(best, ["phi", "theta"], "left").where((F.col("votes") > least) & (F.col("votes") >= F.coalesce("_best", F.lit(0.0)))).drop("_best")
