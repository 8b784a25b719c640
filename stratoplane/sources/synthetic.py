"""Point clouds of known truth, as DataFrames: a noisy plane, a plane with outliers and curvature, and a book of two leaves."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def noisy_plane(spark: SparkSession, n: int = 1000, noise: float = 0.01, seed: int = 1) -> DataFrame:
    """z = 0.2 x + 0.1 y + 1 with normal noise; x and y uniform in (-5, 5)."""
    p = spark.range(n).select(F.col("id").alias("point_id"), (F.rand(seed) * 10 - 5).alias("x"), (F.rand(seed + 1) * 10 - 5).alias("y"))
    return p.withColumn("z", 0.2 * F.col("x") + 0.1 * F.col("y") + 1.0 + noise * F.randn(seed + 2))


def plane_with_outliers(spark: SparkSession, n: int = 20_000, share: float = 0.25, normal=(0.2, -0.3, 0.93), d: float = -1.2, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """A plane of the given normal and offset; a share of points uniform in a cube, with a larger curvature."""
    size = math.sqrt(sum(c * c for c in normal))
    a, b, c = (v / size for v in normal)
    p = spark.range(n).select(F.col("id").alias("point_id"), *((F.rand(seed + k) * 4 - 2).alias(name) for k, name in enumerate(("x", "y", "w"))), (F.pmod(F.col("id") * 7919, F.lit(1000)) < share * 1000).alias("outlier"))
    on = -(a * F.col("x") + b * F.col("y") + d) / c + noise * F.randn(seed + 9)
    k = F.when(F.col("outlier"), 0.05 + 0.05 * F.rand(seed + 10)).otherwise(0.005 * F.rand(seed + 11))
    return p.select("point_id", "x", "y", F.when(F.col("outlier"), F.col("w")).otherwise(on).alias("z"), k.alias("curvature"), "outlier")


def book(spark: SparkSession, angle: float, spacing: float = 0.05, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Two unit squares that share the y axis, the second turned by angle (degrees) about it; true normals are columns."""
    n = int(round(1.0 / spacing)) + 1
    grid = spark.range(2 * n * n).select(F.col("id").alias("point_id"), F.floor(F.col("id") / (n * n)).cast("int").alias("plane_id"), (F.pmod(F.col("id"), F.lit(n)) * spacing).alias("s"), (F.pmod(F.floor(F.col("id") / n), F.lit(n)) * spacing).alias("y"))
    turn = F.radians(F.lit(float(angle))) * F.col("plane_id")
    p = grid.select("point_id", "plane_id", (F.col("s") * F.cos(turn)).alias("x"), "y", (F.col("s") * F.sin(turn)).alias("z"), (-F.sin(turn)).alias("nx_truth"), F.lit(0.0).alias("ny_truth"), F.cos(turn).alias("nz_truth"))
    return p.withColumns({c: F.col(c) + noise * F.randn(seed + k) for k, c in enumerate("xyz")}) if noise else p
