"""Mixing sources to target weights by balanced sampling (the cube method).

Targets come from water filling: every source gets a share of the total by weight, at most CAP times its own size, and what
is cut off is shared out again by weight. A document of size s in a source with target / size = r is taken floor(r) times
and once more with inclusion probability r - floor(r). The flight phase moves these probabilities along the null space
of the balancing constraints (words and documents), so that both totals stay exact until at most as many units as constraints
are undecided; then those landing units of all blocks meet in the next, smaller round. The last few are settled by the
rounding that comes nearest to the source's target, mended by a few exchanges.

Blocks have a bounded number of documents whatever a source's share of the rows is: a hot source just has more blocks,
and no source or block is gathered anywhere. Sources are ranked and given their targets as a table; the driver sees sums over
sources only. Moves are drawn from a hash of source, block and round, so reruns agree.

Rows of equal id, source and size are told apart by a number, so neither repeated rows nor rows without an id gather in a block;
as units they are interchangeable. Null or empty texts have size 0: they are taken 0 words (copies as their probability says,
which no total feels). Long texts are counted in segments. A source's null name is a source of its own, sorted last. Extra
columns are ignored. Empty tables give empty results.
"""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orientation_clusters import ranked
from ..shared_store import written
from ..tables import table
from . import bytetext
from .arrowrows import bounded, kept

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents per block of the flight phase.
BLOCK_ROWS = 4096
_TINY = 1e-9


def with_size(df: DataFrame, id_col: str, text_col: str, group_col: str) -> DataFrame:
    """id, group and the number of words of the whole text (null: 0)."""
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{group_col}` {kinds[group_col]}, size long"

    def run(batches):
        kept(None)
        for b in batches:
            data, offsets = bytetext.column_bytes(b.column(2))
            sizes = np.zeros(b.num_rows, np.int64)
            for lo, hi in bytetext.row_blocks(offsets):
                first = bytetext.word_bounds(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]
                sizes[lo:hi] = np.diff(first)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes)], names=[id_col, group_col, "size"])

    return bounded(df).select(id_col, group_col, text_col).mapInArrow(run, schema)


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """A written table of (words, weight) rows with target: shares of total by weight, none above cap times its words; the excess
    goes to the others by weight until none is above. Each step is one sum over the sources."""
    left, scale, fixed = float(total), None, F.lit(False)
    while True:
        w = sources.where(~fixed).agg(F.sum("weight")).first()[0]
        if not w:
            break
        scale = left / w
        above = ~fixed & (F.lit(scale) * F.col("weight") > F.lit(cap) * F.col("words"))
        more, words = sources.where(above).agg(F.count(F.lit(1)), F.sum("words")).first()
        if not more:
            break
        left -= cap * words
        # Once above, a source stays above, as the scale only grows: so the last scale tells all that are fixed.
        fixed = F.lit(scale) * F.col("weight") > F.lit(cap) * F.col("words")
    share = F.lit(scale or 0.0) * F.col("weight")
    return sources.withColumn("target", F.when(share > F.lit(cap) * F.col("words"), F.lit(cap) * F.col("words")).otherwise(share))


def flight(prob: np.ndarray, sizes: np.ndarray, draw: random.Random) -> np.ndarray:
    """Move the probabilities along the null space of (words, documents); at most two stay strictly between 0 and 1.

    Three open units have a null vector in closed form: the cross product of their two constraint rows."""
    p = prob.astype(float).copy()
    order = [i for i in range(len(p)) if _TINY < p[i] < 1 - _TINY]
    active: list[int] = []
    for i in order:
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        x = (float(sizes[c] - sizes[b]), float(sizes[a] - sizes[c]), float(sizes[b] - sizes[a]))
        if x == (0.0, 0.0, 0.0):
            x = (1.0, -1.0, 0.0)
        q = (p[a], p[b], p[c])
        up = min((1 - q[k]) / x[k] if x[k] > 0 else -q[k] / x[k] for k in range(3) if x[k])
        down = min(q[k] / x[k] if x[k] > 0 else (q[k] - 1) / x[k] for k in range(3) if x[k])
        step = up if draw.random() * (up + down) < down else -down
        active = []
        for k, at in enumerate((a, b, c)):
            v = q[k] + step * x[k]
            p[at] = v = 0.0 if v < _TINY else 1.0 if v > 1 - _TINY else v
            if 0.0 < v < 1.0:
                active.append(at)
    return p


def land(before: np.ndarray, prob: np.ndarray, sizes: np.ndarray, swaps: int = 4) -> np.ndarray:
    """Settle the at most two open units by the rounding with the nearest number of words, then of documents.

    What is still missing is mended by exchanging a unit taken with one not taken, both of them undecided before the
    flight, as long as that brings the words nearer."""
    p = prob.copy()
    at = [i for i in range(len(p)) if 0 < p[i] < 1]
    best = min(
        (abs(sum((k >> j & 1) * sizes[i] for j, i in enumerate(at)) - sum(p[i] * sizes[i] for i in at)), abs(k.bit_count() - sum(p[i] for i in at)), k)
        for k in range(1 << len(at))
    )[2]
    for j, i in enumerate(at):
        p[i] = float(best >> j & 1)
    free = np.flatnonzero((before > _TINY) & (before < 1 - _TINY))
    free = free[np.argsort(sizes[free], kind="stable")]
    want = float((before * sizes).sum())
    for _ in range(swaps):
        off = float((p * sizes).sum()) - want
        out, in_ = free[p[free] == 1], free[p[free] == 0]
        if not len(out) or not len(in_):
            break
        near = np.searchsorted(sizes[in_], sizes[out] - off)
        tries = [(abs(off - float(sizes[out[i]] - sizes[in_[j]])), i, j) for i, n in enumerate(near) for j in (n - 1, n) if 0 <= j < len(in_)]
        gap, i, j = min(tries)
        if gap >= abs(off) - 0.5:
            break
        p[out[i]], p[in_[j]] = 0.0, 1.0
    return p


def source_targets(sized: DataFrame, group_col: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """group, words, documents, weight and target of every source; weights repeat over the names by code point, null last."""
    totals = sized.groupBy(group_col).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("documents"))
    # Named _source, as ranked adds columns of its own.
    placed = ranked(totals.withColumnRenamed(group_col, "_source"), [F.asc_nulls_last("_source")], "_source", "_place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(placed.select("_source", "words", "documents", weight.alias("weight")), "sources")
    return water_fill(sources, share * (sources.agg(F.sum("words")).first()[0] or 0), cap)


def _open_units(rows: pa.Table, seed: int, last: bool) -> pa.Table:
    """One block's flight (and landing in the last round)."""
    rows = rows.combine_chunks().sort_by([(c, "ascending") for c in ("_id", "size", "_copy")])
    sizes = rows.column("size").to_numpy()
    key = f"{seed}/{rows.column('_source')[0].as_py()!r}/{rows.column('_block')[0].as_py()}/{len(rows)}"
    before = rows.column("_prob").to_numpy()
    p = flight(before, sizes, random.Random(zlib.crc32(key.encode())))
    p = land(before, p, sizes) if last else p
    rows = rows.drop_columns(["_block"]).set_column(rows.column_names.index("_prob"), "_prob", pa.array(p))
    return rows.append_column("_open", pc.and_(pc.greater(rows.column("_prob"), 0.0), pc.less(rows.column("_prob"), 1.0)))


def _numbered(counted: DataFrame, count: str, name: str) -> DataFrame:
    """As many rows as count says, numbered from 0; made in two steps, so that no large array is needed for a large count."""
    piece, n = 4096, F.col(count)
    some = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / piece))))
    one = F.sequence(F.col("_piece") * piece, F.least(n, (F.col("_piece") + 1) * piece) - 1)
    return some.withColumn(name, F.explode(one)).drop("_piece", count)


def mixed(sized: DataFrame, id_col: str, group_col: str, block_rows: int = BLOCK_ROWS, seed: int = 7, **how) -> DataFrame:
    """id, group, size, source_size, target and copies for every row of (id, group, size)."""
    targets = written(source_targets(sized, group_col, **how).select(F.col("_source").alias("_g"), F.col("words").alias("source_size"), "target", F.col("documents").alias("_n")), "targets")
    units = sized.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_source"), "size").groupBy("_id", "_source", "size").agg(F.count(F.lit(1)).alias("_rows"))
    units = _numbered(units, "_rows", "_copy").join(targets, F.col("_source").eqNullSafe(F.col("_g"))).drop("_g")
    ratio = F.expr("CASE WHEN source_size > 0 THEN target / source_size ELSE 0D END")
    rest = units.withColumn("_whole", F.floor(ratio).cast("long")).withColumn("_prob", ratio - F.floor(ratio))
    most, parts, last = targets.agg(F.max("_n")).first()[0] or 0, [], False

    def settle(last: bool):
        return lambda rows: _open_units(rows, seed, last)

    while not last:
        last = most <= block_rows
        blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("long")
        schema = ", ".join(f"`{c}` {k}" for c, k in rest.dtypes) + ", _open boolean"
        placed = rest.withColumn("_block", F.pmod(F.xxhash64("_id", "size", "_copy", F.lit(seed + len(parts))), blocks))
        settled = placed.groupBy("_source", "_block").applyInArrow(settle(last), schema)
        if not last:
            settled = written(settled, "cube")
            # A block leaves two open units at most.
            rest, most = settled.where("_open").drop("_open").withColumn("_n", 2 * blocks), 2 * -(-most // block_rows)
        parts.append(settled.where("NOT _open"))
    result = parts[0]
    for df in parts[1:]:
        result = result.unionByName(df)
    return result.select(F.col("_id").alias(id_col), F.col("_source").alias(group_col), "size", "source_size", "target", (F.col("_whole") + F.col("_prob").cast("long")).alias("copies"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each, near each source's target."""
    sized = written(with_size(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sizes")
    return mixed(sized, "doc_id", "source").select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
