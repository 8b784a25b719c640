"""Plane fits as expressions over centred second moments: no function leaves the JVM.

The smallest eigenvalue of the 3x3 covariance has a closed form; its eigenvector is the longest cross product of two rows of
(A - value * I). Everything is algebraic over sums, so Spark combines partial sums before the shuffle.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Vec, clamp, cross, dot, upper


def eigenvalues(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Smallest, middle and largest eigenvalue of the symmetric matrix a (xx, yy, zz, xy, xz, yz)."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3.0
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    dx, dy, dz = a["xx"] - q, a["yy"] - q, a["zz"] - q
    p = F.sqrt((dx * dx + dy * dy + dz * dz + 2.0 * off) / 6.0)
    det = dx * (dy * dz - a["yz"] * a["yz"]) - a["xy"] * (a["xy"] * dz - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dy * a["xz"])
    # p = 0: three equal values, any angle does.
    phi = F.acos(clamp(F.coalesce(det / F.nullif(2.0 * p * p * p, F.lit(0.0)), F.lit(1.0)), -1.0, 1.0)) / 3.0
    low, high = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0), q + 2.0 * p * F.cos(phi)
    return low, 3.0 * q - low - high, high


def smallest_vector(a: dict[str, Column], value: Column) -> Vec:
    """The unit eigenvector of value; NULL where it is not determined (all points on a line or at one place)."""
    rows = [(a["xx"] - value, a["xy"], a["xz"]), (a["xy"], a["yy"] - value, a["yz"]), (a["xz"], a["yz"], a["zz"] - value)]
    ways = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    sizes = [dot(w, w) for w in ways]
    best = F.greatest(*sizes)
    trace = a["xx"] + a["yy"] + a["zz"]
    # The squared cross products scale with the fourth power of the trace.
    n = F.when(best > 1e-24 * trace * trace * trace * trace, F.sqrt(best))
    pick = lambda k: F.when(sizes[0] == best, ways[0][k]).when(sizes[1] == best, ways[1][k]).otherwise(ways[2][k])
    return tuple(pick(k) / F.nullif(n, F.lit(0.0)) for k in range(3))


_PAIRS = {"xx": ("x", "x"), "yy": ("y", "y"), "zz": ("z", "z"), "xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}


def moments(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, n, cx, cy, cz and the centred second moments xx ... yz (divided by n or by the sum of weights).

    Two passes keep map coordinates from cancelling; the second reuses the keys' partitioning."""
    w = F.col(weight) if weight else F.lit(1.0)
    total = F.nullif(F.sum(w), F.lit(0.0))
    centre = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *((F.sum(w * F.col(c)) / total).alias(f"c{c}") for c in "xyz"))
    if keys:
        both = points.join(centre.drop("n"), keys)
    else:
        both = points.crossJoin(F.broadcast(centre.drop("n")))  # one row
    d = {c: F.col(c) - F.col(f"c{c}") for c in "xyz"}
    sums = [(F.sum(w * d[i] * d[j]) / total).alias(k) for k, (i, j) in _PAIRS.items()]
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.first(f"c{c}").alias(f"c{c}") for c in "xyz"), *sums)


def fitted(moment_rows: DataFrame, least: int = 3) -> DataFrame:
    """moments with a, b, c, d (upward unit normal and offset), rmse, l0, l1, l2 and curvature; NULL below ``least`` points
    and for points on a line."""
    a = {k: F.col(k) for k in _PAIRS}
    low, mid, high = eigenvalues(a)
    df = moment_rows.withColumns({"l0": low, "l1": mid, "l2": high})
    n = smallest_vector(a, F.col("l0"))
    enough = F.col("n") >= least
    df = df.withColumns({k: F.when(enough, v) for k, v in zip(("_a", "_b", "_c"), n)})
    a_, b_, c_ = upper((F.col("_a"), F.col("_b"), F.col("_c")))
    df = df.withColumns({"a": a_, "b": b_, "c": c_}).drop("_a", "_b", "_c")
    df = df.withColumns({
        "d": -(F.col("a") * F.col("cx") + F.col("b") * F.col("cy") + F.col("c") * F.col("cz")),
        "rmse": F.when(F.col("a").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("l0")))),
        "curvature": F.col("l0") / (F.col("xx") + F.col("yy") + F.col("zz") + 1e-12),
    })
    # One generated row keeps later filters from copying these long expressions into each of their terms.
    made = ["a", "b", "c", "d", "rmse", "l0", "l1", "l2", "curvature"]
    rest = [c for c in df.columns if c not in made]
    return df.select(*rest, F.explode(F.array(F.struct(*made))).alias("_fit")).select(*rest, "_fit.*")


def plane_fit(points: DataFrame, keys: list[str], weight: str | None = None, least: int = 3) -> DataFrame:
    """The least-squares plane of each key's points."""
    return fitted(moments(points, keys, weight), least)


def unbiased(fits: DataFrame) -> DataFrame:
    """fits with eigenvalues and error of the covariance over N - 1; NULL for a single point."""
    f = F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))
    return fits.withColumns({**{c: F.col(c) * f for c in ("l0", "l1", "l2")}, "rmse": F.sqrt(F.greatest(F.lit(0.0), F.col("l0")) * f)})
