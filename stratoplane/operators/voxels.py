"""Voxel grids: keys, occupancy, index tables, down-sampling, tiles of a labelled cloud."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["vx", "vy", "vz"]


def bounds(points: DataFrame) -> DataFrame:
    """One row: the cloud's axis-aligned box and its number of points."""
    return points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))))


def with_voxels(points: DataFrame, size: float, origin: DataFrame | None = None) -> DataFrame:
    """points with vx, vy, vz = floor((p - minimum) / size). The origin is the minimum of ``origin`` (the full cloud), one row."""
    low = bounds(origin if origin is not None else points).select("min_x", "min_y", "min_z")
    keyed = points.crossJoin(F.broadcast(low))  # one row
    return keyed.withColumns({f"v{c}": F.floor((F.col(c) - F.col(f"min_{c}")) / F.lit(size)).cast("long") for c in "xyz"}).drop("min_x", "min_y", "min_z")


def voxel_centre(axis: str, low: Column, size: float) -> Column:
    return low + (F.col(f"v{axis}") + 0.5) * size


def occupancy(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_points"))


def voxel_index(keyed: DataFrame, least: int = 1) -> DataFrame:
    """The index table of a voxel export: key, points, box and file name of each voxel with at least ``least`` points."""
    box = [f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    index = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_points"), *box).where(F.col("num_points") >= least)
    return index.withColumn("file_name", F.format_string("voxel_%d_%d_%d", *KEY))


def occupancy_profile(keyed: DataFrame) -> DataFrame:
    n = F.col("num_points")
    return occupancy(keyed).agg(
        F.count(F.lit(1)).alias("voxels"), F.avg(n).alias("mean"), F.min(n).alias("min"), F.percentile(n, 0.25).alias("p25"),
        F.percentile(n, 0.5).alias("p50"), F.percentile(n, 0.75).alias("p75"), F.max(n).alias("max"),
    )


def downsample(keyed: DataFrame) -> DataFrame:
    """One centroid for each voxel."""
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_points"), *(F.avg(c).alias(c) for c in "xyz"))


def tiles(points: DataFrame, size: float, overlap: float) -> DataFrame:
    """points once for each tile that holds them: tiles of ``size`` start every size * (1 - overlap) from the cloud's minimum, half-open.

    The candidate tiles of a point follow from arithmetic and are exploded; nothing is joined but the one-row origin."""
    low = bounds(points).select("min_x", "min_y", "min_z")
    step = size * (1.0 - overlap)
    out = points.crossJoin(F.broadcast(low))  # one row
    for c in "xyz":
        at = F.col(c) - F.col(f"min_{c}")
        last = F.floor(at / F.lit(step)).cast("long")
        first = F.greatest(F.lit(0), F.floor((at - size) / F.lit(step)).cast("long"))
        out = out.withColumn(f"t{c}", F.explode(F.sequence(first, last)))
        out = out.where((at >= F.col(f"t{c}") * F.lit(step)) & (at < F.col(f"t{c}") * F.lit(step) + size))
    return out.drop("min_x", "min_y", "min_z")


TILE = ["tx", "ty", "tz"]


def tile_report(tiled: DataFrame, label: str, background: int = -1, row_bytes: int = 36) -> DataFrame:
    """Points, structure points and their share, instances and memory of each tile."""
    on = F.col(label) != background
    return tiled.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(on).alias("n_structure"), F.count_distinct(F.when(on, F.col(label))).alias("n_instances"),
    ).withColumn("frac_pts", F.col("n_structure") / F.col("n_points")).withColumn("mem_mb", F.col("n_points") * F.lit(float(row_bytes)) / 1048576.0)


def hash_order(*ids: str) -> Column:
    """A fixed pseudo-random order of integer ids that any engine with 64-bit integers can repeat."""
    mixed = F.lit(0).cast("long")
    for k, i in enumerate(ids):
        mixed = F.pmod(mixed * 31 + F.pmod(F.col(i).cast("long"), F.lit(1000003)) * 48271 + 12345 + k, F.lit(2147483647))
    return mixed


def stratified_sample(tiled: DataFrame, ident: str, label: str, most: int, least: int = 1, background: int = -1) -> DataFrame:
    """Of each tile with at least ``least`` points at most ``most``, structure and background in proportion, in hash order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*TILE)
    s = tiled.withColumn("_on", (F.col(label) != background).cast("int")).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    s = s.withColumn("_on_n", F.sum("_on").over(w))
    on_quota = F.when(F.col("_n") <= most, F.col("_on_n")).otherwise(F.floor(F.lit(float(most)) * F.col("_on_n") / F.col("_n")))
    quota = F.when(F.col("_n") <= most, F.col("_n")).otherwise(F.when(F.col("_on") == 1, on_quota).otherwise(F.lit(most) - on_quota))
    rank = F.row_number().over(Window.partitionBy(*TILE, "_on").orderBy(hash_order(ident), ident))
    return s.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_on", "_n", "_on_n", "_rank")


def centred_sample(tiled: DataFrame, label: str, background: int = -1) -> DataFrame:
    """Training columns of a tile's points: coordinates about the tile's centroid, semantic and instance label."""
    from pyspark.sql import Window

    w = Window.partitionBy(*TILE)
    out = tiled.withColumns({f"{c}0": F.col(c) - F.avg(c).over(w) for c in "xyz"})
    return out.withColumn("segment", (F.col(label) != background).cast("int")).withColumn("instance", F.when(F.col(label) != background, F.col(label)).otherwise(-1))


def split(blocks: DataFrame, keys: list[str], ratios: tuple[float, float, float]) -> DataFrame:
    """blocks with split: floor(n * r0) train, then validation, then floor(n * r2) test, in hash order of the keys.

    One row per block of a data set; blocks are counted, ranked within hash buckets and shifted by the buckets' totals, so
    no single task sorts them all."""
    from pyspark.sql import Window

    parts = 64
    b = blocks.withColumn("_h", hash_order(*keys)).withColumn("_p", F.floor(F.col("_h") * F.lit(parts) / F.lit(2147483647)).cast("int"))
    sizes = b.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_total"))  # at most ``parts`` rows
    ranked = b.join(F.broadcast(before), "_p").withColumn("_rank", F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys)) + F.col("_before"))
    train, test = F.floor(F.col("_total") * ratios[0]), F.floor(F.col("_total") * ratios[2])
    name = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") > F.col("_total") - test, "test").otherwise("val")
    return ranked.withColumn("split", name).drop("_h", "_p", "_before", "_total", "_rank")


def split_summary(blocks: DataFrame, size: str) -> DataFrame:
    """Blocks and points of every split, and the mean, least and most points of a block."""
    n = F.col(size)
    return blocks.groupBy("split").agg(F.count(F.lit(1)).alias("blocks"), F.sum(n).alias("points"), F.avg(n).alias("mean_points"), F.min(n).alias("min_points"), F.max(n).alias("max_points"))


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """n, centroid (avg_x, ...) and box (min_x, max_x, ...) by keys."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def voxel_name(*more: str) -> Column:
    """A text that names a voxel (and what more columns say), different for different ones however large the grid is."""
    return F.concat_ws("_", *(F.col(c).cast("string") for c in (*KEY, *more)))
