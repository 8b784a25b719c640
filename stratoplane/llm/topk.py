"""Exact top-k inner products by reading sorted lists without random access (NRA).

Every dimension of a block of vectors is a sorted list. A query reads the lists of its positive components from the top and
those of its negative components from the bottom, all to the same depth. What has been read is known exactly; what has not
lies between the list's far end and the frontier, so every vector has a lower and an upper bound of its score. A query's bar is
the k-th largest lower bound, or what it brings along from an earlier block; vectors with an upper bound under it are outsiders
and are left, for this query alone. The depth doubles up to half a list, then the unread rest is halved, until no more than k
vectors are left that can qualify or the lists are at their end; the scores of those that remain are resolved. Bounds of
several queries are matrix products over the vectors that any of them still holds: reading to a depth equals clamping a column at
its list's frontier.

Queries are dealt to groups and vectors to chunks by a hash of the id; a cell is one group and one chunk, a partition of its own.
Its queries come first and are held, its vectors stream past them in blocks, and a query's k-th best score so far is its bar for
the next block. No side is joined, broadcast or gathered: all that a task holds are the queries of a group (HELD_BYTES) and a
block of vectors. First, small groups of queries meet about one block of vectors; the k-th scores found there are the bars that the
queries take to all cells. A cell gives k rows a query; the k best of these follow by rank, ties to the smaller id.
Shuffled are V * Q / (queries of a group) vectors and Q * V / (VECTORS * CHUNK) queries.

Components are scaled, floored to integers, and scored in floating point that is exact for the sizes at hand (int64 beyond).
Vectors that are null or hold null or non-finite components take no part; a shorter vector is filled up with 0. Rows without
an id take no part. Rows of one id are one vector: repeats count once, and of several vectors the first in byte order stands.
A query's own id is no candidate for it. Extra columns are ignored. Empty tables give empty results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared_store import written
from ..tables import table
from .arrowrows import bounded, kept

K, SCALE, EVERY = 5, 256.0, 50
#: Vectors of a block, queries of a group in the first search, blocks of a chunk, queries whose bounds are held at once, the first
#: depth as a share of a list; bytes of a group's queries and of a block's vectors as doubles.
VECTORS, QUERIES, CHUNK, AT_ONCE, FIRST_DEPTH = 8192, 4096, 16, 64, 1 / 8
HELD_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20
_EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """id, v (bytes of the floored components: 4 each where that is enough, else 8), dims; one row an id."""

    def run(batches):
        kept(None)
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for key, v in zip(ids, b.column(1)):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(np.asarray(v.values, np.float64) * scale)
                if np.isfinite(x).all():
                    small = np.abs(x).max(initial=0) < 1 << 31
                    out.append((key, x.astype("<i4" if small else "<f8").tobytes(), len(x)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32()))], names=["id", "v", "dims"])

    rows = bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(run, "id long, v binary, dims int")
    return rows.groupBy("id").agg(F.min(F.struct("v", "dims")).alias("x")).select("id", "x.v", "x.dims")


def _matrix(rows: list[pa.RecordBatch], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids in order, their vectors, and their bars."""
    rows = pa.Table.from_batches(rows).combine_chunks()
    ids, widths = rows.column("id").to_numpy(), rows.column("dims").to_pylist()
    order, out = np.argsort(ids, kind="stable"), np.zeros((len(ids), dims))
    for k, (v, n) in enumerate(zip(rows.column("v"), widths)):
        raw = v.as_buffer()
        if n:
            out[k, :n] = np.frombuffer(raw, "<i4" if raw.size == 4 * n else "<f8")
    return ids[order], out[order], rows.column("bar").to_numpy()[order]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def depths(n: int, first: float = FIRST_DEPTH) -> list[int]:
    """Entries of a list of n that have been read after each step: doubling to a half, then halving what is unread."""
    out, share = [], first
    while share < 0.5:
        out.append(share)
        share *= 2
    rest = 0.5
    while rest * n >= 1 and rest > 1 / 32:
        out.append(1 - rest)
        rest /= 2
    return sorted({max(1, int(s * n)) for s in out} | {n}) if n else []


def narrowed(q: np.ndarray, bars: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, lists: np.ndarray | None = None):
    """For each depth: entries read, and for each query (row) the vectors (columns) that can still be among its k best."""
    lists = np.sort(x, axis=0) if lists is None else lists
    up, down, bars, alive = np.maximum(q, 0), np.minimum(q, 0), bars.copy(), ~own
    for read in depths(len(x)):
        top, bottom, low, high = lists[len(x) - read], lists[read - 1], lists[0], lists[-1]
        at = np.flatnonzero(alive.any(axis=0))
        y, some = x[at], alive[:, at]
        lower = up @ np.where(y >= top, y, low).T + down @ np.where(y <= bottom, y, high).T
        upper = up @ np.maximum(y, top).T + down @ np.minimum(y, bottom).T
        lower[~some] = -np.inf
        if len(at) >= k:
            bars = np.maximum(bars, _kth(lower, k))
        # Equal bounds stay: ties are settled by id at the end.
        alive[:, at] = some & (upper >= bars[:, None])
        yield read, alive
        if (alive.sum(axis=1) <= k).all():
            return


def block_top(q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K):
    """(query, id, score) of those of the k best of x for every query that reach its bar."""
    exact = not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < _EXACT
    lists = np.sort(x, axis=0)
    for lo in range(0, len(q), AT_ONCE):
        part, part_ids = q[lo : lo + AT_ONCE], q_ids[lo : lo + AT_ONCE]
        alive = part_ids[:, None] != ids[None, :]
        if exact:
            for _, alive in narrowed(part, bars[lo : lo + AT_ONCE], x, ~alive, k, lists):  # noqa: B007
                pass
        for i in range(len(part)):
            at = np.flatnonzero(alive[i])
            scores = x[at] @ part[i] if exact else x[at].astype(np.int64) @ part[i].astype(np.int64)
            best = np.argsort(-scores, kind="stable")[:k]
            for j in best[scores[best] >= bars[lo + i]]:
                yield int(part_ids[i]), int(ids[at[j]]), int(scores[j])


class _Search:
    """The k best vectors so far of the queries of a cell."""

    def __init__(self, k: int, dims: int, block: int):
        self.k, self.dims, self.block = k, dims, block
        self.asked, self.waiting, self.n, self.queries, self.best = [], [], 0, None, {}

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows)

    def pass_by(self, rows: pa.RecordBatch) -> None:
        while self.n + rows.num_rows >= self.block:
            cut = self.block - self.n
            self.waiting.append(rows.slice(0, cut))
            rows = rows.slice(cut)
            self._meet()
        if rows.num_rows:
            self.waiting.append(rows)
            self.n += rows.num_rows

    def _meet(self) -> None:
        if self.queries is None:
            self.queries, self.asked = (_matrix(self.asked, self.dims) if self.asked else ()), []
            self.place = {key: at for at, key in enumerate(self.queries[0].tolist())} if self.queries else {}
        if self.queries:
            ids, x, _ = _matrix(self.waiting, self.dims)
            q_ids, q, bars = self.queries
            fresh: dict[int, list[tuple[int, int]]] = {}
            for query, vec, score in block_top(q_ids, q, bars, ids, x, self.k):
                fresh.setdefault(query, []).append((-score, vec))
            for query, more in fresh.items():
                self.best[query] = best = sorted(self.best.get(query, []) + more)[: self.k]
                if len(best) == self.k:
                    bars[self.place[query]] = max(bars[self.place[query]], -best[-1][0])
        self.waiting, self.n = [], 0

    def result(self):
        """Batches of query_id, vec_id, score."""
        if self.n:
            self._meet()
        found = [(query, vec, -less) for query, best in self.best.items() for less, vec in best]
        for lo in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[lo : lo + (1 << 16)])], names=["query_id", "vec_id", "score"])


def _met(queries: DataFrame, vectors: DataFrame, groups: int, chunks: int, k: int, dims: int, block: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each chunk of vectors for each query (with bar) that reach its bar."""
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "v", "dims", "bar", F.lit(True).alias("asks"), dealt(groups).alias("g"), every(chunks).alias("c"))
    past = vectors.select("id", "v", "dims", F.lit(0.0).alias("bar"), F.lit(False).alias("asks"), every(groups).alias("g"), dealt(chunks).alias("c"))
    rows = asked.unionByName(past).withColumn("cell", F.col("g") * F.lit(chunks) + F.col("c")).drop("g", "c")
    # A partition a cell: work goes by cells, not by their few bytes.
    rows = rows.repartitionById(groups * chunks, "cell").sortWithinPartitions("cell", F.desc("asks"))

    def run(batches):
        kept(None)
        now, search = None, None
        for b in batches:
            cells, asks = b.column("cell").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != now:
                    if search:
                        yield from search.result()
                    now, search = cells[lo], _Search(k, dims, block)
                (search.ask if asks[lo] else search.pass_by)(b.slice(lo, hi - lo))
        if search:
            yield from search.result()

    return bounded(rows).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id meets is_query (a condition on ``id``)."""
    rows = written(integer_vectors(df, id_col, vector_col, scale), "vectors")
    n_vectors, n_queries, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max("dims"), F.lit(0))).first()
    width = 8 * max(1, dims)
    block, held = max(k, min(VECTORS, BLOCK_BYTES // width)), max(1, HELD_BYTES // width)
    blocks, groups = max(1, -(-n_vectors // block)), max(1, -(-n_queries // held))
    # Chunks of CHUNK blocks, or smaller ones where these would leave cores idle.
    chunks = min(blocks, max(-(-blocks // CHUNK), -(-2 * df.sparkSession.sparkContext.defaultParallelism // groups)))
    none = F.lit(float("-inf"))
    queries = rows.where(is_query)
    # Thresholds: every query meets about one block of vectors.
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == 0)
    found = _met(queries.withColumn("bar", none), some, max(1, -(-n_queries // min(QUERIES, held))), 1, k, dims, block)
    bars = written(found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").cast("double").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n"), "bars")
    asked = written(queries.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", none)), "asked")
    best = _met(asked, rows, groups, chunks, k, dims, block)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every vector whose id is divisible by EVERY, against all rows."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 l AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
       FROM l q JOIN l c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
