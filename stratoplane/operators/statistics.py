"""Histograms, density estimates, distribution distances and grouped summaries as tables for plots and reports."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orientation_clusters import ranked


def fixed_histogram(values: DataFrame, column: str, width: float, low: float, high: float, keys: list[str] = ()) -> DataFrame:
    """Counts in bins of a fixed width; the last bin includes the upper edge, values outside are left out."""
    bins = int(round((high - low) / width))
    k = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width).cast("int"))
    inside = values.where((F.col(column) >= low) & (F.col(column) <= high)).withColumn("bin", k)
    return inside.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")).withColumn("center", low + (F.col("bin") + 0.5) * width)


def equal_width_histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` bins between the smallest and the largest value, with the density of each bin."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    v = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    width = F.nullif((F.col("hi") - F.col("lo")) / F.lit(bins), F.lit(0.0))
    k = F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width).cast("int")), F.lit(0))
    counted = v.withColumn("bin", k).groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return counted.select("bin", "count", (F.col("lo") + F.col("bin") * width).alias("left_edge"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"), (F.col("count") / F.nullif(F.col("n") * width, F.lit(0.0))).alias("density"))


def adaptive_bins(n: int, low: int = 10, high: int = 50) -> int:
    """A number of bins that grows with the root of n."""
    return max(low, min(high, int(math.sqrt(n)))) if n else low


def kde_1d(values: DataFrame, column: str, points: int) -> DataFrame:
    """A Gaussian density with Scott's bandwidth at ``points`` places between minimum and maximum."""
    one = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"), F.stddev_samp(column).alias("s"))
    v = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(one))  # one row
    h = F.nullif(F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(0.0))
    v = v.withColumn("h", h).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    u = (at - F.col(column)) / F.col("h")
    v = v.withColumn("at", at).withColumn("k", F.exp(-0.5 * u * u) / (F.col("h") * F.lit(math.sqrt(2 * math.pi)) * F.col("n")))
    return v.groupBy("i").agg(F.first("at").alias("at"), F.sum("k").alias("density"))


def kde_sphere(poles: DataFrame, direction: str, dip: str, h: float, direction_step: int, dip_step: int) -> DataFrame:
    """A density of orientations on a grid of dip directions and dips, scaled to 0..1; directions wrap round.

    Each pole adds to every grid place; the sums are combined before the shuffle."""
    grid = poles.select(F.col(direction).alias("_a"), F.col(dip).alias("_d"))
    grid = grid.withColumn("dir", F.explode(F.sequence(F.lit(0), F.lit(360 - direction_step), F.lit(direction_step))))
    grid = grid.withColumn("dip", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(dip_step))))
    r = lambda c: F.radians(c.cast("double"))
    dx = F.cos(r(F.col("dir"))) - F.cos(r(F.col("_a")))
    dy = F.sin(r(F.col("dir"))) - F.sin(r(F.col("_a")))
    dz = (F.col("dip") - F.col("_d")) / 90.0
    sums = grid.groupBy("dir", "dip").agg(F.sum(F.exp(-(dx * dx + dy * dy + dz * dz) / (2.0 * h * h))).alias("s"))
    ends = sums.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return sums.crossJoin(F.broadcast(ends)).select("dir", "dip", ((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("density"))


def summary(values: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """mean, std, median, quantiles and ends of columns for all rows and for each value of a flag (grouping sets)."""
    long = None
    for c in columns:
        part = values.select(F.lit(c).alias("metric"), F.col(flag).cast("string").alias("grp"), F.col(c).cast("double").alias("v"))
        long = part if long is None else long.unionByName(part)
    every = long.unionByName(long.withColumn("grp", F.lit("all")))
    v = F.col("v")
    q = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    return every.groupBy("metric", "grp").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *(F.percentile(v, p).alias(name) for name, p in q.items()), F.min(v).alias("min"), F.max(v).alias("max"))


def patch_statistics(points: DataFrame, keys: list[str], member: Column, columns: list[str]) -> DataFrame:
    """mean, std, p50 and p90 of columns among members and others of each key, and their difference."""
    out = [F.count(F.lit(1)).alias("n_total"), F.count_if(member).alias("n_patch")]
    for c in columns:
        for name, flag in (("patch", member), ("other", ~member)):
            v = F.when(flag, F.col(c))
            out += [F.avg(v).alias(f"{name}_{c}_mean"), F.stddev_pop(v).alias(f"{name}_{c}_std"), F.percentile(v, 0.5).alias(f"{name}_{c}_p50"), F.percentile(v, 0.9).alias(f"{name}_{c}_p90")]
    stats = points.groupBy(*keys).agg(*out)
    return stats.withColumns({f"diff_{c}_{s}": F.col(f"patch_{c}_{s}") - F.col(f"other_{c}_{s}") for c in columns for s in ("mean", "std", "p50", "p90")})


def ecdf(values: DataFrame, column: str) -> DataFrame:
    """value, cdf: each distinct value with the share of values up to it.

    Values are counted first; ranks come from counts within range buckets and the buckets' totals."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ends = counted.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    buckets = 64
    place = F.coalesce(F.least(F.lit(buckets - 1), F.floor((F.col("value") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / buckets, F.lit(0.0))).cast("int")), F.lit(0))
    counted = counted.crossJoin(F.broadcast(ends)).withColumn("b", place)
    sums = counted.groupBy("b").agg(F.sum("c").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("total"))  # at most ``buckets`` rows
    run = F.sum("c").over(Window.partitionBy("b").orderBy("value"))
    return counted.join(F.broadcast(before), "b").select("value", ((run + F.col("before")) / F.col("total")).alias("cdf"))


def _quantiles(values: DataFrame, column: str, n: int) -> DataFrame:
    return values.agg(F.percentile(column, F.array(*(F.lit(k / (n - 1)) for k in range(n)))).alias("q"))


def wasserstein_quantile(a: DataFrame, b: DataFrame, column: str, n: int = 101) -> DataFrame:
    """The mean distance of ``n`` equally spaced quantiles."""
    both = _quantiles(a, column, n).select(F.col("q").alias("p")).crossJoin(_quantiles(b, column, n))  # one row each
    total = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select((total / F.lit(n)).alias("distance"))


def wasserstein_ranked(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The mean distance of as many equally spaced quantiles as the larger sample has values: its own values in order against
    the smaller one's, interpolated between its ranks. One row."""
    n, m = a.count(), b.count()
    if n < m:
        a, b, n, m = b, a, m, n
    of = lambda df, at, name: ranked(df.select(F.col(column).alias("v")), [F.col("v")], "v", at).select((F.col(at) - 1).alias(at), F.col("v").alias(name))
    at = F.col("k") * F.lit((m - 1) / max(1, n - 1))
    low, right = F.floor(at + 1e-9).cast("long"), of(b, "r", "w")
    big = of(a, "k", "v").withColumns({"lo": low, "hi": F.least(low + 1, F.lit(m - 1)), "part": F.greatest(at - low, F.lit(0.0))})
    both = big.join(right.select(F.col("r").alias("lo"), F.col("w").alias("p")), "lo").join(right.select(F.col("r").alias("hi"), F.col("w").alias("q")), "hi")
    return both.agg(F.avg(F.abs(F.col("v") - F.col("p") - F.col("part") * (F.col("q") - F.col("p")))).alias("distance"))


def histogram_l1(a: DataFrame, b: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """The sum of absolute differences of two normalised histograms."""
    def share(df: DataFrame, name: str) -> DataFrame:
        h = fixed_histogram(df, column, (high - low) / bins, low, high).select("bin", "count")
        return h.crossJoin(F.broadcast(h.agg(F.sum("count").alias("t")))).select("bin", (F.col("count") / F.col("t")).alias(name))

    both = share(a, "p").join(share(b, "q"), "bin", "full")
    return both.agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("distance"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The largest distance of two empirical distribution functions."""
    both = a.select(F.col(column).alias("value"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(column).alias("value"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counted = both.where("value IS NOT NULL").groupBy("value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    ends = counted.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    place = F.coalesce(F.least(F.lit(63), F.floor((F.col("value") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / 64, F.lit(0.0))).cast("int")), F.lit(0))
    counted = counted.crossJoin(F.broadcast(ends)).withColumn("b", place)
    sums = counted.groupBy("b").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    w = Window.orderBy("b")
    before = sums.select("b", (F.sum("sx").over(w) - F.col("sx")).alias("bx"), (F.sum("sy").over(w) - F.col("sy")).alias("by"))  # at most 64 rows
    run = Window.partitionBy("b").orderBy("value")
    steps = counted.join(F.broadcast(before), "b").select(((F.sum("x").over(run) + F.col("bx")) / F.col("nx") - (F.sum("y").over(run) + F.col("by")) / F.col("ny")).alias("gap"))
    return steps.agg(F.max(F.abs("gap")).alias("distance"))


def curvature_weights(points: DataFrame, column: str, quantile: float, least: float) -> DataFrame:
    """weight = max(exp(-(k / k0)^2), least) with k0 the quantile of the column; missing values count as the median."""
    k = F.when(~F.isnan(column), F.col(column))
    one = points.agg(F.percentile(k, quantile).alias("_k0"), F.percentile(k, 0.5).alias("_mid"))
    rated = points.crossJoin(F.broadcast(one)).withColumn("_r", F.coalesce(k, "_mid") / F.nullif(F.greatest(F.col("_k0"), F.lit(1e-12)), F.lit(0.0)))
    return rated.withColumn("weight", F.greatest(F.exp(-F.col("_r") * F.col("_r")), F.lit(least))).drop("_k0", "_mid", "_r")


def mean_direction(values: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """The arithmetic and the circular mean of azimuths."""
    r = F.radians(column)
    a = F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r))))
    return values.groupBy(*keys).agg(F.avg(column).alias("mean_dir_arith"), F.when(a < 0, a + 360.0).otherwise(a).alias("mean_dir_circular"), F.count(F.lit(1)).alias("n"))


def largest(rows: DataFrame, size: str, ident: str, most: int) -> DataFrame:
    """The ``most`` rows of largest size, ties to the smaller id, numbered from 0 as show_id."""
    top = rows.orderBy(F.desc(size), ident).limit(most)
    place = F.row_number().over(Window.orderBy(F.desc(size), ident))  # over ``most`` rows
    return top.withColumn("show_id", (place - 1).cast("long"))


def quantile_edges(values: DataFrame, column: str, bins: int, least: float = 1e-12) -> DataFrame:
    """k, edge: bins + 1 edges at equal shares of the values, each at least ``least`` above the one before. One row of quantiles is
    all that is held at once."""
    one = values.agg(F.percentile(column, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("q"))
    step = lambda done, x: F.concat(done, F.array(F.when((F.size(done) > 0) & (x <= F.element_at(done, -1)), F.element_at(done, -1) + F.lit(least)).otherwise(x)))
    rising = F.aggregate("q", F.array().cast("array<double>"), step)
    return one.select(F.posexplode(rising).alias("k", "edge"))
