"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidate edges.

A document's set holds its distinct runs of SHINGLE words (lower-cased A-Z); a shorter document has its whole word
sequence as one element, an empty one nothing. Documents are linked from a similarity of 75/100 on; the classes are
the connected components of these links.

1. Signatures: one permutation deals a set's hashes to BANDS * ROWS bins, the smallest of each bin is kept, and an empty
   bin borrows from the first filled bin of its own fixed probing sequence (optimal densification), so that each bin
   agrees with probability equal to the similarity, whatever the set's size. A pair at the threshold shares a band with
   probability 1 - (1 - 0.75**ROWS)**BANDS = 0.99998.
2. Equal sets are one representative from here on; a group of copies costs one row each.
3. Stars: every bucket (band, hash) links its members to its smallest representative only, so pairs grow with members,
   not with their square. Pairs whose sizes allow it and whose signatures estimate at least MARGIN (over four standard deviations
   under the threshold) are confirmed on the full sets, and the confirmed ones joined to components.
4. Further stars find what the first missed, links of members that are not similar to their star's centre. In each round the
   buckets that still hold several components take new centres among the members that were none yet, and link them to the
   members of other components. A bucket with up to SETTLED of these takes them all, so it is settled exactly; a larger one takes
   CENTRES, those with most links so far (the text that others were copied from is soon one of them), then by a hash, which
   gives the many buckets of a group many different centres. Pairs stay linear in members, by a fixed factor.
5. When a round finds no new link, the members that were no centre yet of buckets that still hold several components are
   settled exactly: each two of them in different components meet in a tile of at most about 2 * TILE members, which compares their
   sizes and sketches, and members with a plausible partner meet again in tiles with their full sets. So no pair of a bucket is left
   out, whatever its size, and no pair becomes a row: a tile hands over members, then links that join components, never more
   than its members. Comparisons of sketches grow with the square of a bucket's members that are like no other; so do rows from TILE
   members on, divided by TILE. Sets are compared by what sets them apart from the hashes that most of their tile hold.

A star of any size is confirmed without copies of its centre: pairs are dealt by centre and a salt of the member, and a task
streams a centre's members past its set. Full sets are made again from the texts of the documents that need them, found by a
filter of bounded size, or by a join where there are too many for it; texts are not shuffled in the first case.

Rows with null or empty text are classes of their own, and so are rows without an id (their class is null). Repeated rows
of one id and text give one row per input row and count as copies of each other; an id that comes with several texts has the
links of all of them. Texts of any length are hashed whole, in segments. Extra columns are ignored. An empty table gives an
empty result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shared_store import written
from ..tables import table
from . import bytetext
from .arrowrows import bounded, kept
from .idfilter import IdFilter, fits

U64 = np.uint64
SHINGLE, SHARE = 5, (75, 100)
BANDS, ROWS = 40, 5
#: Estimated similarity from which pairs are confirmed; new centres that a large bucket takes in a round, members that a small one has; least salts of a centre.
MARGIN, CENTRES, SETTLED, SALTS = 0.6, 4, 16, 64
#: Members of a side of a tile, hashes of its sets.
TILE, WEIGHT = 4096, 1 << 20
_BINS = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bin that an empty bin asks in its t-th try: a fixed pseudo-random table.
_PROBES = (bytetext.mix(np.arange(64 * _BINS, dtype=U64) + U64(0x5851F42D4C957F2D)) % U64(_BINS)).astype(np.int64).reshape(64, _BINS)


def shingle_sets(column: pa.Array):
    """For each row of a text column its sorted array of distinct shingle hashes."""
    data, offsets = bytetext.column_bytes(column)
    for lo, hi in bytetext.row_blocks(offsets):
        part = bytetext.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = bytetext.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
        words = bytetext.word_hashes(part, starts, ends)
        grams = bytetext.gram_hashes(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield np.array([bytetext.sequence_hash(words[a:b], salt=b - a)], U64)
            else:
                yield np.zeros(0, U64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    bins = ((hashes >> U64(32)) * U64(_BINS) >> U64(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.full(_BINS, _EMPTY, U64)
    out[bins[head]] = hashes[head]
    own, open_, t = out.copy(), np.flatnonzero(out == _EMPTY), 0
    while len(open_):
        if t < len(_PROBES):
            asked = _PROBES[t][open_]
        else:  # very small sets: every bin's further tries walk on from its last
            asked = (_PROBES[t % 64][open_] * (2 * (t // 64) + 1) + t) % _BINS
        out[open_] = own[asked]
        open_, t = open_[own[asked] == _EMPTY], t + 1
    return out


_BAND_SALT = bytetext.mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One bucket hash per band."""
    rows = sig.reshape(BANDS, ROWS)
    out = _BAND_SALT.copy()
    for k in range(ROWS):
        out = bytetext.join_hashes(out, rows[:, k])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, n (set size), f1, f2 (a 128-bit fingerprint of the set), bands (bucket hashes), sketch (a byte of each bin)."""

    def run(batches):
        kept(None)
        for b in batches:
            ids, rows = b.column(0), []
            for hashes in shingle_sets(b.column(1)):
                if len(hashes):
                    sig = signature(hashes)
                    f1, f2 = (int(bytetext.mix(hashes + U64(s)).sum(dtype=U64)) for s in (0x1F123BB5, 0x9D2C5680))
                    rows.append((len(hashes), f1 - (1 << 63), f2 - (1 << 63), band_hashes(sig).astype(np.int64), (sig & U64(255)).astype(np.uint8).tobytes()))
                else:
                    rows.append((0, 0, 0, np.zeros(0, np.int64), b""))
            n, f1, f2, bands, sketch = zip(*rows) if rows else ([],) * 5
            places = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(places, pa.array(np.concatenate(bands) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, pa.array(sketch, pa.binary())], names=["_id", "n", "f1", "f2", "bands", "sketch"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("_id"), text_col).mapInArrow(run, "_id long, n long, f1 long, f2 long, bands array<long>, sketch binary")


def shingles_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, shingles (packed set) of the wanted ids and, by chance, a few others."""
    wanted = written(wanted.select("_id").distinct(), "wanted")
    count = wanted.count()
    rows = bounded(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    few = IdFilter(wanted, "_id", count) if fits(count) else None
    if few is None:
        rows = rows.join(wanted, "_id", "left_semi")

    def sets(batches):
        kept(None)
        for b in batches:
            if few is not None:
                b = b.filter(pa.array(few.contains(b.column(0).to_numpy())))
            found = [x.tobytes() for x in shingle_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["_id", "shingles"])

    return written(rows.mapInArrow(sets, "_id long, shingles binary"), "shingle-sets")


def similar_sets(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    part, whole = SHARE
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(both) - common)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarities by the share of equal sketch bytes, less what agrees by chance."""
    return ((others == one).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def plausible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches estimate at least MARGIN."""
    # Both sides of the second join come straight from a shuffle, so a large star can be split.
    both = pairs.join(heads.select(F.col("_id").alias("b"), F.col("sketch").alias("y")), "b").join(heads.select(F.col("_id").alias("a"), F.col("sketch").alias("x")), "a")

    def keep(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, _BINS) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array(estimates(x, y) >= MARGIN))

    return both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def _members_past_centres(batches):
    """Rows (a, salt, b, shingles) sorted so that a centre's set (b is null) comes before its members: the similar pairs (a, b)."""
    now, centres = None, []
    for batch in batches:
        out = []
        for a, salt, b, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            x = np.frombuffer(x.as_buffer(), U64)
            if (a, salt) != now:
                now, centres = (a, salt), []
            if b is not None:
                if any(similar_sets(c, x) for c in centres):
                    out.append((a, b))
            elif not any(np.array_equal(c, x) for c in centres):
                centres.append(x.copy())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of a written table of pairs (a, b) that are similar on their full sets."""
    held = shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("_id")), docs, id_col, text_col)
    salts = max(SALTS, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    centres = dealt.select("a", "salt").distinct().join(held.withColumnRenamed("_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    members = dealt.join(held.withColumnRenamed("_id", "b"), "b").select("a", "salt", "b", "shingles")
    rows = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.mapInArrow(_members_past_centres, "a long, b long")


def _may_be_similar(x: str, y: str):
    """Whether sets of these sizes can be similar."""
    part, whole = SHARE
    return F.lit(whole) * F.least(x, y) >= F.lit(part) * F.greatest(x, y)


def _linked(pairs: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The similar ones of candidate pairs, as a written table."""
    some = written(plausible(pairs.distinct(), heads), "pairs")
    return written(confirmed(some, docs, id_col, text_col), "links")


def _with_partner(rows: pa.Table, one_side: bool) -> pa.Table:
    """The members of a tile that have a plausible partner of another component; of a tile of two sides, one on the other side."""
    rows = rows.combine_chunks().sort_by("n")
    n, comp, slot = (rows.column(c).to_numpy() for c in ("n", "comp", "slot"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, _BINS)
    found = np.zeros(len(n), bool)
    # The larger members that can be similar to a member come next to it.
    ends = np.searchsorted(SHARE[0] * n, SHARE[1] * n, side="right").tolist()
    for i, end in enumerate(ends):
        other = comp[i + 1 : end] != comp[i]
        if not one_side:
            other &= slot[i + 1 : end] != slot[i]
        at = np.flatnonzero(other) + i + 1
        if len(at):
            at = at[estimates(sketch[i], sketch[at]) >= MARGIN]
            found[at] = True
            found[i] |= len(at) > 0
    return rows.select(["h", "_id", "n", "comp"]).filter(pa.array(found))


def _differences(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner, column: the symmetric difference of each set (of n hashes, one after the other) and the hashes that more than half of them hold.

    Two sets differ from each other in what their differences from a third differ in, and the differences of near copies are short."""
    m, owner = len(n), np.repeat(np.arange(len(n)), n)
    _, column, count = np.unique(sets, return_inverse=True, return_counts=True)
    usual = 2 * count > m
    place, mine = np.cumsum(usual) - 1, usual[column]
    lacks = np.ones((m, int(usual.sum())), bool)
    lacks[owner[mine], place[column[mine]]] = False
    who, which = np.nonzero(lacks)
    return np.concatenate([owner[~mine], who]), np.concatenate([column[~mine], np.flatnonzero(usual)[which]])


def _links_of_tile(rows: pa.Table, one_side: bool) -> pa.Table:
    """Similar pairs (a, b) of members of different components, exactly; of those that join the same components one is enough."""
    rows = rows.append_column("size", pc.divide(pc.binary_length(rows.column("shingles")), 8)).combine_chunks().sort_by("size")
    rows = rows.filter(pc.greater(rows.column("size"), 0))
    ids, comp, slot, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("_id", "comp", "slot", "size"))
    owner, column = _differences(np.frombuffer(b"".join(rows.column("shingles").to_pylist()), U64), n)
    m, length = len(n), np.bincount(owner, minlength=len(n))
    held = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    both = held[column] > 1
    owner, column = owner[both], column[both]
    # What a member's difference holds, and the members whose differences hold a hash.
    columns, first = column[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    owners, held = owner[np.argsort(column, kind="stable")], np.bincount(column, minlength=len(held))
    start = np.cumsum(held) - held
    (part, whole), out = SHARE, []
    ends = np.searchsorted(part * n, whole * n, side="right").tolist()
    for i, end in enumerate(ends):
        asked = columns[first[i] : first[i + 1]]
        many = held[asked]
        at = np.arange(many.sum()) + np.repeat(start[asked] - np.cumsum(many) + many, many)
        shared = np.bincount(owners[at], minlength=m)[i + 1 : end]
        apart, total = length[i] + length[i + 1 : end] - 2 * shared, n[i] + n[i + 1 : end]
        near = (whole * (total - apart) >= part * (total + apart)) & (comp[i + 1 : end] != comp[i])
        if not one_side:
            near &= slot[i + 1 : end] != slot[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if comp[j] != comp[i]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _tiles(batches):
    """The rows of each tile, of rows sorted by bucket and tile, and whether it has one side only."""
    now, parts = None, []
    for b in batches:
        h, i, j = (b.column(c).to_numpy() for c in ("h", "i", "j"))
        cuts = (np.flatnonzero((np.diff(h) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(h)]):
            if lo < hi:
                if parts and (h[lo], i[lo], j[lo]) != now:
                    yield pa.Table.from_batches(parts), now[1] == now[2]
                    parts = []
                now = (h[lo], i[lo], j[lo])
                parts.append(b.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts), now[1] == now[2]


def _in_tiles(members: DataFrame, weight: Column, others: DataFrame, found, schema: str) -> DataFrame:
    """What found gives for each tile of members (h, _id, comp ...) joined with others by _id; a side has about TILE members and WEIGHT of weight at most."""

    def run(batches):
        kept(None)
        for tile in _tiles(batches):
            yield from found(*tile).to_batches()

    sides = members.groupBy("h").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE), F.sum(weight) / F.lit(WEIGHT))).cast("int").alias("sides"))
    placed = members.join(sides, "h").withColumn("slot", F.pmod(F.xxhash64("_id"), F.col("sides")).cast("int"))
    placed = placed.join(others, "_id").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = placed.drop("sides").withColumns({"i": F.least("slot", "t"), "j": F.greatest("slot", "t")}).drop("t")
    return bounded(tiles.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")).mapInArrow(run, schema)


def settled_links(members: DataFrame, found: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join whatever is similar of the members (h, _id, n, was) of a bucket that were no centre and are in different components."""
    free = members.where(~F.col("was")).join(found.select(F.col("node").alias("_id"), "component"), "_id", "left")
    free = written(free.select("h", "_id", "n", F.coalesce("component", "_id").alias("comp")), "free")
    several = free.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("h")
    some = _in_tiles(free.join(several, "h"), F.lit(0), heads.select("_id", "sketch"), _with_partner, "h long, _id long, n long, comp long").distinct()
    some = written(some.groupBy("h", "_id", "comp").agg(F.sum("n").alias("n")), "partners")
    held = shingles_of(some, docs, id_col, text_col)
    return written(_in_tiles(some, F.col("n"), held, _links_of_tile, "a long, b long").distinct(), "links")


def further_stars(members: DataFrame, found: DataFrame, links: list[DataFrame], number: int) -> tuple[DataFrame, DataFrame]:
    """The members (h, _id, n, was) of buckets with several components, after their new centres are marked, and the pairs (a, b) of
    new centres and members of other components."""
    placed = members.join(found.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("comp", F.coalesce("component", "_id")).drop("component")
    state = placed.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count_if(~F.col("was")).alias("open"))
    several = written(state.where("c1 <> c2 AND open > 0").select("h", "open"), "open-buckets")
    rest = written(placed.join(several, "h"), "rest")
    free = rest.where(~F.col("was"))
    ends = links[0]
    for more in links[1:]:
        ends = ends.unionByName(more)
    degrees = ends.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("degree"))
    large = free.where(F.col("open") > SETTLED).join(degrees, "_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    slot = F.pmod(F.xxhash64("_id", "h", F.lit(number)), F.lit(CENTRES))
    drawn = large.groupBy("h", slot.alias("slot")).agg(F.max_by(F.struct("_id", "n", "comp"), F.struct("degree", F.xxhash64("_id", F.lit(number)))).alias("c")).select("h", "c.*")
    centres = written(free.where(F.col("open") <= SETTLED).select("h", "_id", "n", "comp").unionByName(drawn), "centres")
    them = centres.select("h", F.col("_id").alias("c"), F.col("n").alias("cn"), F.col("comp").alias("ccomp"))
    met = rest.join(them, "h").where((F.col("comp") != F.col("ccomp")) & _may_be_similar("n", "cn"))
    pairs = met.select(F.least("_id", "c").alias("a"), F.greatest("_id", "c").alias("b"))
    marked = rest.select("h", "_id", "n", "was").join(centres.select("h", "_id", F.lit(True).alias("now")), ["h", "_id"], "left")
    return marked.select("h", "_id", "n", F.coalesce("now", "was").alias("was")), pairs


def near_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that can be reached by links) for every row."""
    signed = written(signatures(docs, id_col, text_col), "signatures")
    full, same = signed.where("n > 0 AND _id IS NOT NULL"), ["n", "f1", "f2"]
    classes = written(full.groupBy(*same).agg(F.min("_id").alias("rep")), "classes")
    named = written(full.select("_id", *same).join(classes, same).select("_id", "n", "rep"), "named")
    heads = full.join(classes.withColumnRenamed("rep", "_id"), ["_id", *same], "left_semi").dropDuplicates(["_id", *same])
    heads = written(heads.select("_id", "n", "bands", "sketch"), "heads")
    buckets = heads.select("_id", "n", F.explode("bands").alias("h"))
    shared = buckets.groupBy("h").agg(F.min(F.struct("_id", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = written(shared.select("h", F.col("c._id").alias("a"), F.col("c.n").alias("an")), "shared")
    members = written(buckets.join(shared, "h"), "buckets")
    stars = members.where((F.col("a") != F.col("_id")) & _may_be_similar("n", "an")).select("a", F.col("_id").alias("b"))
    links = _linked(stars, heads, docs, id_col, text_col)
    # An id with several texts is one document: its classes belong together.
    several = named.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("_id", "a")
    own = named.join(several, "_id").select("a", F.col("rep").alias("b")).where("a <> b")
    found = components(links.unionByName(own), "a", "b")
    rest, number, linked = members.select("h", "_id", "n", (F.col("_id") == F.col("a")).alias("was")), 0, [links]
    while True:
        rest, pairs = further_stars(rest, found, linked, number)
        extra = _linked(pairs, heads, docs, id_col, text_col)
        if extra.isEmpty():
            break
        linked.append(extra)
        # The components so far are stars already; only the new links have to be worked in.
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra), "a", "b")
        rest, number = written(rest, "members"), number + 1
    last = settled_links(rest, found, heads, docs, id_col, text_col)
    if not last.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last), "a", "b")
    settled = named.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("_id", "n", F.coalesce("component", "rep").alias("component"))
    alone = signed.where("n = 0 OR _id IS NULL").select("_id", "n", F.col("_id").alias("component"))
    return settled.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; the smallest id of each class is kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return near_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("kept", kept)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
       UNION SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
 e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
 m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
