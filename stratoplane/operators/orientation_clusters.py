"""Quality-weighted density and fuzzy clustering of plane orientations.

A discontinuity is a row (disc_id, nx, ny, nz, ...) with an upward unit normal. Centres are few (their number is bounded by the
first layer's clusters and the manual seeds), so they are a small table; discontinuities may be many.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, plane_angle, vec
from ..shared_store import written
from .blocks import Angle, alike_pairs, density_clusters

N, C = ("nx", "ny", "nz"), ("mx", "my", "mz")


def trace_or_longest_segment(discs: DataFrame, trace: str, longest: str) -> Column:
    return F.when(F.col(trace) > 0, F.col(trace)).otherwise(F.col(longest))


def quality(discs: DataFrame, rmse: str = "rmse", trace: str = "trace", w_rmse: float = 0.5, w_trace: float = 0.5) -> DataFrame:
    """discs with rmse_norm, trace_norm (min-max over all) and q = (w_r (1 - rmse_norm) + w_l trace_norm) / (w_r + w_l)."""
    ends = discs.agg(F.min(rmse).alias("_r0"), F.max(rmse).alias("_r1"), F.min(trace).alias("_t0"), F.max(trace).alias("_t1"))
    d = discs.crossJoin(F.broadcast(ends))  # one row
    norm = lambda c, lo, hi: F.coalesce((F.col(c) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)), F.lit(0.0))
    d = d.withColumns({"rmse_norm": norm(rmse, "_r0", "_r1"), "trace_norm": norm(trace, "_t0", "_t1")}).drop("_r0", "_r1", "_t0", "_t1")
    return d.withColumn("q", (w_rmse * (1.0 - F.col("rmse_norm")) + w_trace * F.col("trace_norm")) / (w_rmse + w_trace))


def ranked(rows: DataFrame, order: list[Column], value: str, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in a total order that starts with ``value``; any number of rows.

    Rows are range-partitioned in that order, counted by partition, and numbered within partitions: no task holds all rows."""
    spread = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_local", local).join(before, "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def first_layer(discs: DataFrame, share: float) -> DataFrame:
    """discs with q_rank (best first, ties by id), n and first_layer: the best max(1, round-half-even(share * n))."""
    r = ranked(discs, [F.desc("q"), F.col("disc_id")], "q", "q_rank")
    r = r.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return r.withColumn("first_layer", F.col("q_rank") <= F.greatest(F.lit(1), F.rint(F.lit(share) * F.col("n")).cast("long")))


def sample_weights(layered: DataFrame, share: float, low: float = 0.1, decay: float = 1.0) -> DataFrame:
    """alpha = s * beta. s is 1 in the first layer and 0.8, 0.6, 0.4, 0.2 or ``low`` by place in the rest; beta is
    exp(-decay * rmse_norm) among the round-half-even(share * n) lowest qualities, else 1."""
    in_first = F.greatest(F.lit(1), F.rint(F.lit(share) * F.col("n")).cast("long"))
    place = (F.col("q_rank") - in_first) / F.nullif(F.col("n") - in_first, F.lit(0))
    s = F.when(F.col("first_layer"), 1.0).when(place < 0.2, 0.8).when(place < 0.4, 0.6).when(place < 0.6, 0.4).when(place < 0.8, 0.2).otherwise(low)
    worst = F.col("n") - F.col("q_rank") < F.rint(F.lit(share) * F.col("n"))
    beta = F.when(worst, F.exp(-decay * F.col("rmse_norm"))).otherwise(1.0)
    return layered.withColumns({"s": s, "beta": beta}).withColumn("alpha", F.col("s") * F.col("beta"))


def continuous_weights(layered: DataFrame, gamma: float, low: float = 0.1) -> DataFrame:
    """The continuous variant: alpha = max(q^gamma, low), 1 in the first layer."""
    return layered.withColumn("alpha", F.when(F.col("first_layer"), 1.0).otherwise(F.greatest(F.lit(low), F.pow(F.col("q"), F.lit(gamma)))))


def angular_pairs(rows: DataFrame, eps: float) -> DataFrame:
    """Pairs i < j of normals at most eps degrees apart as undirected planes, and their angle.

    The angle is a chord on the sphere, so blocks of space hold what can meet; the opposite normals of one side take part
    too, for planes near the vertical."""
    return alike_pairs(rows, "disc_id", N, eps)


def density_minimum(first: int, ratio: float = 0.05) -> int:
    """The least neighbours of a core in a first layer of ``first`` rows, itself counted: a share of them (halves to even), 3 at least."""
    return max(3, round(ratio * first))


def angular_dbscan(rows: DataFrame, eps: float, least: int) -> DataFrame:
    return density_clusters(rows, "disc_id", N, Angle(eps), least)


def centres_of(labelled: DataFrame) -> DataFrame:
    """label, mx, my, mz, members: the normalised vector sum of each cluster (noise left out)."""
    sums = labelled.where("label >= 0").groupBy("label").agg(*(F.sum(c).alias(m) for c, m in zip(N, C)), F.count(F.lit(1)).alias("members"))
    n = F.nullif(F.sqrt(dot(vec(*C), vec(*C))), F.lit(0.0))
    return sums.select("label", *((F.col(m) / n).alias(m) for m in C), "members")


def with_seeds(centres: list[tuple[float, float, float]], seeds: list[tuple[float, float, float]], eps: float) -> list[tuple[float, float, float, bool]]:
    """Centres, then those manual seeds farther than eps degrees from every centre so far (seeds see earlier seeds)."""
    out = [(*c, False) for c in centres]
    for s in seeds:
        angles = [np.degrees(np.arccos(min(1.0, abs(sum(x * y for x, y in zip(s, c)))))) for c in out]
        if not angles or min(angles) > eps:
            out.append((*s, True))
    return out


def memberships(rows: DataFrame, centres: DataFrame, m: float = 2.0) -> DataFrame:
    """rows x centres with the angle (radians, at least 1e-12) and the fuzzy membership mu.

    Centres (k, mx, my, mz) are a handful of rows; Spark broadcasts them if they are below its threshold."""
    both = rows.crossJoin(centres)
    both = both.withColumn("angle", F.greatest(F.acos(F.least(F.lit(1.0), F.abs(dot(vec(*N), vec(*C))))), F.lit(1e-12)))
    w = F.pow(F.col("angle"), F.lit(-2.0 / (m - 1.0)))
    return both.withColumn("mu", w / F.sum(w).over(Window.partitionBy("disc_id")))


def centre_update(member: DataFrame, m: float = 2.0) -> DataFrame:
    """k and the new centre: the normalised sum of alpha * mu^m * n, normals turned to the old centre's side."""
    side = F.when(dot(vec(*N), vec(*C)) < 0, -1.0).otherwise(1.0)
    w = F.col("alpha") * F.pow(F.col("mu"), F.lit(m)) * side
    sums = member.groupBy("k").agg(*(F.sum(w * F.col(c)).alias(x) for c, x in zip(N, C)))
    n = F.nullif(F.sqrt(dot(vec(*C), vec(*C))), F.lit(0.0))
    return sums.select("k", *((F.col(x) / n).alias(x) for x in C))


def fuzzy_c_means(rows: DataFrame, centres: list[tuple], m: float = 2.0, tolerance: float = 0.01, rounds: int = 100):
    """The memberships (of the centres before the last update) and the final centres; one aggregation per round."""
    spark, now = rows.sparkSession, [tuple(map(float, c[:3])) for c in centres]
    if not now:
        return None, []
    frame = lambda cs: spark.createDataFrame([(k, *c) for k, c in enumerate(cs)], "k int, mx double, my double, mz double")
    for _ in range(rounds):
        member = memberships(rows, frame(now), m)
        found = {r["k"]: (r["mx"], r["my"], r["mz"]) for r in centre_update(member, m).collect()}  # one row per centre
        new = [found[k] if k in found and found[k][0] is not None else c for k, c in enumerate(now)]
        turn = max(np.degrees(np.arccos(min(1.0, abs(float(np.dot(a, b)))))) for a, b in zip(now, new))
        now = new
        if turn < tolerance:
            break
    return member, now


def centre_masses(member: DataFrame, k: int, m: float = 2.0) -> list[float]:
    """The sum of alpha * mu^m of all samples for each of ``k`` centres, the weight of a centre in a merge."""
    found = {r["k"]: r["w"] for r in member.groupBy("k").agg(F.sum(F.col("alpha") * F.pow(F.col("mu"), F.lit(m))).alias("w")).collect()}  # one row per centre
    return [float(found.get(i) or 0.0) for i in range(k)]


def merge_centres(centres: list[tuple], mass: list[float], eps: float, loops: int) -> tuple[list[tuple], list[int]]:
    """Merge the closest two centres while they are less than eps degrees apart, at most ``loops`` times.

    The merged centre goes last; returns the centres and for each old one its new number."""
    items = [(np.array(c, float), float(w), [k]) for k, (c, w) in enumerate(zip(centres, mass))]
    for _ in range(loops):
        best = min(((float(np.degrees(np.arccos(min(1.0, abs(a[0] @ b[0]))))), i, j) for i, a in enumerate(items) for j, b in enumerate(items) if i < j), default=None)
        if best is None or best[0] >= eps:
            break
        _, i, j = best
        a, b = items[i], items[j]
        s = a[0] * a[1] + b[0] * b[1] * (1 if a[0] @ b[0] >= 0 else -1)
        items = [x for k, x in enumerate(items) if k not in (i, j)] + [(s / (np.linalg.norm(s) or 1), a[1] + b[1], a[2] + b[2])]
    number = [0] * len(centres)
    for k, (_, _, old) in enumerate(items):
        for o in old:
            number[o] = k
    return [tuple(x[0].tolist()) for x in items], number


def assigned(member: DataFrame, least: float) -> DataFrame:
    """disc_id, label (the centre with the largest membership, lowest number first), mu and noise (mu below ``least``)."""
    best = member.groupBy("disc_id").agg(F.max_by(F.struct("k", "mu"), F.struct("mu", -F.col("k"))).alias("b"))
    return best.select("disc_id", F.col("b.k").alias("label"), F.col("b.mu").alias("mu"), (F.col("b.mu") < least).alias("noise"))


def confidence(member: DataFrame, labels: DataFrame) -> DataFrame:
    """k, members (noise left out) and confidence = sum(alpha * mu) / sum(alpha) over the members."""
    own = member.join(labels.where("NOT noise").select("disc_id", F.col("label").alias("k")), ["disc_id", "k"])
    return own.groupBy("k").agg(F.count(F.lit(1)).alias("members"), (F.sum(F.col("alpha") * F.col("mu")) / F.nullif(F.sum("alpha"), F.lit(0.0))).alias("confidence"))


def angular_radius(labelled: DataFrame, centres: DataFrame) -> DataFrame:
    """label and the largest angle between a cluster's centre and its members."""
    both = labelled.join(centres.select("label", *C), "label")
    return both.groupBy("label").agg(F.max(plane_angle(vec(*N), vec(*C))).alias("radius"))
