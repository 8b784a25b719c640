"""Plane fits of voxels kept up to date while points arrive.

Sums of coordinates about a voxel's own centre are additive and small, so one pass of sums is enough and a stream can keep
them as state: one row per voxel, updated by each micro-batch. The same function serves batches.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planefit import fitted
from ..operators.voxels import KEY


def voxel_planes(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), least: int = 3) -> DataFrame:
    """vx, vy, vz, n, centroid, plane, rmse and eigenvalues of each voxel of a fixed grid; points may be a stream."""
    keyed = points.withColumns({f"v{c}": F.floor((F.col(c) - o) / size).cast("long") for c, o in zip("xyz", origin)})
    keyed = keyed.withColumns({f"_{c}": F.col(c) - (F.lit(o) + (F.col(f"v{c}") + 0.5) * size) for c, o in zip("xyz", origin)})
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    sums = keyed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"_{c}").alias(f"s{c}") for c in "xyz"), *(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}{j}") for i, j in pairs),
    )
    mean = {c: F.col(f"s{c}") / F.col("n") for c in "xyz"}
    out = [*KEY, "n", *((mean[c] + F.lit(o) + (F.col(f"v{c}") + 0.5) * size).alias(f"c{c}") for c, o in zip("xyz", origin))]
    return fitted(sums.select(*out, *((F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"{i}{j}") for i, j in pairs)), least)


def follow(points: DataFrame, size: float, name: str, checkpoint: str | None = None, **how):
    """Start a stream that keeps the table ``name`` (in memory, for small grids) of changed voxels' planes."""
    writer = voxel_planes(points, size, **how).writeStream.outputMode("update").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
