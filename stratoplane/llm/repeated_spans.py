"""Removal of passages that repeat across documents, with a count-min prefilter.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts, with the same word sequence, in a
document with a smaller id.

1. Prefilter. A window's anchor is the smallest hash among its runs of GRAM words, so equal windows have equal anchors, and
   neighbouring windows mostly share one. Each partition counts the documents that hold an anchor; its sketch goes out in
   pieces, by the high bits of the anchor's hash. Pieces of all partitions are added up to a count-min sketch, and the
   anchors that came with them are looked up in it. A window's estimate (its anchor's) is never below the number of documents
   that hold the window, so windows estimated at one document cannot repeat: none is lost. The sketch has LOAD counters for
   each anchor that the texts' bytes let expect, in as many pieces as that takes, so it filters alike at every size; a piece
   is a few hundred kilobytes, and no task or driver ever holds them all.
2. The anchors estimated at two documents or more go back to the texts: as a filter of bounded size (``idfilter``), or, where
   they are too many for it, by a join of the texts' anchors and then of the texts.
3. Exact grouping of the windows of these anchors. The windows of one anchor and document travel as one packed row, and
   every anchor's rows are streamed in the order of document ids: the first document to show a window keeps it, later ones
   lose it. Anchors with an estimate above HOT are first streamed by (anchor, salt of the document); of these only each
   salt's first holders go on, a row for each different window of an anchor, to the same question over the salts.
4. The marked windows, merged to spans, meet their documents by id.

Null and empty texts have no words. Rows of one id count as one document, each text loses what is its own; rows without an id keep
their whole text. Repeats
within one document stay. Texts of any length are hashed whole, in segments. Extra columns are ignored, and so are columns with
names of results. Empty tables give empty results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared_store import written
from ..tables import table
from . import bytetext
from .arrowrows import bounded, kept
from .idfilter import IdFilter, fits

U64 = np.uint64
WINDOW, GRAM = 50, 10
#: Rows of the sketch, counters in a row for each expected anchor, bytes of text that hold one anchor, counters in a row of a piece (as bits).
DEPTH, LOAD, ANCHOR_BYTES, PIECE_BITS = 2, 8, 96, 16
#: The estimate from which an anchor is salted; salts at least; anchors of a partition that are counted together.
HOT, SALTS, TOGETHER = 100, 64, 1 << 20
_SALT = [0x8F1BBCDC68C4D3A9, 0x5A827999CA62C1D6]


def window_anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each window: a sliding minimum over the hashes of runs of GRAM words."""
    low, size, span = bytetext.gram_hashes(words, GRAM), 1, WINDOW - GRAM + 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return low if size == span else np.minimum(low[: len(low) - (span - size)], low[span - size :])


def anchor_runs(column: pa.Array):
    """For each block of rows: word hashes, and the runs of windows of one row with one anchor (row, anchor, first, last + 1).

    first and last count words from the block's first word; ``begin`` has the first word of each row."""
    data, offsets = bytetext.column_bytes(column)
    for lo, hi in bytetext.row_blocks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, begin = bytetext.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
        if len(starts) < WINDOW:
            continue
        words = bytetext.word_hashes(part, starts, ends)
        anchors = window_anchors(words)
        row = bytetext.spans_rows(begin)[: len(anchors)]
        valid = np.arange(len(anchors)) + WINDOW <= begin[row + 1]
        fresh = np.ones(len(anchors), bool)
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
        first = np.flatnonzero(fresh & valid)
        if not len(first):
            continue
        stops = np.append(np.flatnonzero(fresh | ~valid), len(anchors))
        last = stops[np.searchsorted(stops, first, "right")]
        yield lo, words, begin, row[first], anchors[first], first, last


def _slots(anchors: np.ndarray, depth: int) -> np.ndarray:
    """An anchor's counter in a row of its piece."""
    return (bytetext.mix(anchors ^ U64(_SALT[depth])) >> U64(64 - PIECE_BITS)).astype(np.int64)


def sketch_pieces(docs: DataFrame, text_col: str) -> int:
    """Pieces of a sketch with LOAD counters a row for each anchor that texts of this size hold."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size * LOAD // ANCHOR_BYTES) >> PIECE_BITS)


def estimated_repeats(docs: DataFrame, text_col: str, pieces: int) -> DataFrame:
    """anchor, hot: the anchors that the merged sketch estimates in two documents or more, and whether in more than HOT."""
    hot_from = HOT

    def count(batches):
        kept(None)
        held, size = [], 0

        def sketch():
            anchors, n = np.unique(np.concatenate(held), return_counts=True)
            piece = (bytetext.mix(anchors) % U64(pieces)).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            anchors, n, piece = anchors[order], np.minimum(n[order], 255).astype(np.uint8), piece[order]
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for lo in range(0, len(starts), 4096):
                at = np.append(starts, len(piece))[lo : lo + 4097]
                packed = [pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(((at - at[0]) * w).astype(np.int32)), pa.py_buffer(x[at[0] : at[-1]].tobytes())]) for x, w in ((anchors, 8), (n, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(piece[at[:-1]]), *packed], names=["piece", "anchors", "counts"])

        for b in batches:
            for _, _, _, row, anchors, _, _ in anchor_runs(b.column(0)):
                order = np.lexsort((anchors, row))
                row, anchors = row[order], anchors[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
                held.append(anchors[once])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield from sketch()
                    held, size = [], 0
        if held:
            yield from sketch()

    def estimate(batches):
        now, parts = None, []

        def settle():
            anchors = np.concatenate([a for a, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            least = None
            for d in range(DEPTH):
                slot = _slots(anchors, d)
                row = np.bincount(slot, counts, minlength=1 << PIECE_BITS)[slot]
                least = row if least is None else np.minimum(least, row)
            found, at = np.unique(anchors[least >= 2], return_index=True)
            hot = least[least >= 2][at] > hot_from
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(hot)], names=["anchor", "hot"])

        for b in batches:
            for piece, anchors, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if piece != now and parts:
                    yield settle()
                    parts = []
                now = piece
                parts.append((np.frombuffer(anchors.as_buffer(), U64).copy(), np.frombuffer(counts.as_buffer(), np.uint8).copy()))
        if parts:
            yield settle()

    parts = bounded(docs).select(text_col).mapInArrow(count, "piece long, anchors binary, counts binary")
    return written(parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(estimate, "anchor long, hot boolean"), "anchors")


def _packed_windows(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The hashes of the windows from first to last, packed, for each run."""
    windows, n = bytetext.gram_hashes(words, WINDOW), last - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    places = np.concatenate([[0], np.cumsum(n * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(windows[at].tobytes())])


_WINDOWS = "anchor long, doc long, mark long, first long, hot boolean, windows binary"


def windows_by_filter(docs: DataFrame, id_col: str, text_col: str, repeats: DataFrame, count: int) -> DataFrame:
    """anchor, doc, mark (a hash of the text), first (word), hot and the packed hashes of each run of windows with an anchor of repeats; a filter finds them in
    the texts where they are, with a few others by chance."""
    some, often = IdFilter(repeats, "anchor", count), IdFilter(repeats.where("hot"), "anchor", count)

    def find(batches):
        kept(None)
        for b in batches:
            ids, marks = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for lo, words, begin, row, anchors, first, last in anchor_runs(b.column(1)):
                hit = np.flatnonzero(some.contains(anchors))
                if len(hit):
                    first, last, row, anchors = first[hit], last[hit], row[hit], anchors[hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.view(np.int64)), pa.array(ids[lo + row]), pa.array(marks[lo + row]), pa.array(first - begin[row]), pa.array(often.contains(anchors)), _packed_windows(words, first, last)],
                        names=["anchor", "doc", "mark", "first", "hot", "windows"],
                    )

    return bounded(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(find, _WINDOWS)


def windows_by_join(docs: DataFrame, id_col: str, text_col: str, repeats: DataFrame) -> DataFrame:
    """As windows_by_filter, for any number of repeats: the texts' anchors meet them, and the runs found meet the texts again."""

    def runs(batches):
        kept(None)
        for b in batches:
            ids, marks = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for lo, _, begin, row, anchors, first, last in anchor_runs(b.column(1)):
                columns = anchors.view(np.int64), ids[lo + row], marks[lo + row], first - begin[row], last - begin[row]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "doc", "mark", "first", "last"])

    def hashes(batches):
        kept(None)
        for b in batches:
            data, offsets = bytetext.column_bytes(b.column(1))
            for k, (doc, mark, found) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3))):
                part = data[offsets[k] : offsets[k + 1]]
                starts, ends, _ = bytetext.word_bounds(part, np.array([0, len(part)]))
                anchor, first, last, hot = (found.values.field(name).to_numpy(zero_copy_only=False) for name in ("anchor", "first", "last", "hot"))
                own = pa.array([doc] * len(first), pa.int64()), pa.array([mark] * len(first), pa.int64())
                packed = _packed_windows(bytetext.word_hashes(part, starts, ends), first, last)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *own, pa.array(first), pa.array(hot.astype(bool)), packed], names=["anchor", "doc", "mark", "first", "hot", "windows"])

    held = bounded(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    found = held.mapInArrow(runs, "anchor long, doc long, mark long, first long, last long").join(repeats, "anchor")
    found = found.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last", "anchor", "hot")).alias("runs"))
    return held.join(found, ["doc", "mark"]).select("doc", "text", "mark", "runs").mapInArrow(hashes, _WINDOWS)


def _stream(keys: list[str], forward: bool):
    """Stream rows sorted by keys and document: marks the windows that an earlier document of the key has shown.

    Gives (doc, mark, first, n, null, null) for n consecutive marked windows; with forward also (doc, null, null, null, anchor, hash),
    once for each different window, for the document that shows it first."""

    def run(batches):
        kept(None)
        now, seen = None, {}
        for b in batches:
            docs_, marks, firsts, packed = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc", "mark", "first", "windows"))
            key_rows = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys)))
            out = []
            for key, doc, mark, first, hashes in zip(key_rows, docs_, marks, firsts, packed):
                if key != now:
                    now, seen = key, {}
                start, k = None, 0
                for k, h in enumerate(np.frombuffer(hashes, np.int64).tolist()):
                    holder = seen.get(h)
                    if holder is None:
                        seen[h] = doc
                        if forward:
                            out.append((doc, None, None, None, key[0], h))
                    elif holder != doc:
                        start = k if start is None else start
                        continue
                    if start is not None:
                        out.append((doc, mark, first + start, k - start, None, None))
                        start = None
                if start is not None:
                    out.append((doc, mark, first + start, k + 1 - start, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "mark", "first", "n", "anchor", "hash"])

    return run


def _late_windows(batches):
    """Rows (doc, mark, first, windows, gone) with the packed hashes that the document has to lose: its (first, n) runs of them."""
    for b in batches:
        out = []
        for doc, mark, first, windows, gone in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), b.column(4)):
            hit = np.isin(np.frombuffer(windows.as_buffer(), np.int64), gone.values.to_numpy())
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            out += [(doc, mark, first + lo, hi - lo) for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "mark", "first", "n"])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, by_join: bool | None = None) -> DataFrame:
    """doc, mark, spans: for each document (and text) with repeated passages the array of (first, n) runs of marked windows, in order.

    by_join settles how anchors get back to the texts; without it their number does."""
    repeats = estimated_repeats(docs, text_col, sketch_pieces(docs, text_col))
    count = repeats.count()
    by_join = not fits(count) if by_join is None else by_join
    rows = windows_by_join(docs, id_col, text_col, repeats) if by_join else windows_by_filter(docs, id_col, text_col, repeats, count)
    rows = written(rows, "windows")
    names = "doc long, mark long, first long, n long, anchor long, hash long"
    few = rows.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "doc", "first")
    marks = few.select("anchor", "doc", "mark", "first", "windows").mapInArrow(_stream(["anchor"], False), names)
    salts = max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = rows.where("hot").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    dealt = hot.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "first")
    streamed = written(dealt.select("anchor", "salt", "doc", "mark", "first", "windows").mapInArrow(_stream(["anchor", "salt"], True), names), "hot-windows")
    # A salt's first holders, a row for each different window: at most one for every salt. The first of all keeps it.
    heads = streamed.where("hash IS NOT NULL").select("anchor", "hash", "doc")
    keepers = written(heads.groupBy("anchor", "hash").agg(F.min("doc").alias("keeper"), F.max("doc").alias("z")).where("keeper <> z").drop("z"), "keepers")
    gone = heads.join(keepers, ["anchor", "hash"]).where("doc <> keeper").groupBy("anchor", "doc").agg(F.collect_set("hash").alias("gone"))
    late = hot.join(gone, ["anchor", "doc"]).select("doc", "mark", "first", "windows", "gone").mapInArrow(_late_windows, "doc long, mark long, first long, n long")
    found = ["doc", "mark", "first", "n"]
    every = marks.select(found).unionByName(streamed.where("n IS NOT NULL").select(found)).unionByName(late)
    return every.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_removed and the kept words (joined by one space) of every row."""
    kind = dict(docs.dtypes)[id_col]
    own = F.col(id_col).cast("long") == F.col("_doc"), F.xxhash64(text_col) == F.col("_mark")
    both = bounded(docs).select(id_col, text_col).join(spans.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "spans"), list(own), "left").select(id_col, text_col, "spans")

    def cut(batches):
        kept(None)
        for b in batches:
            out_n, out_gone, out_kept = [], [], []
            for text, marked in zip(b.column(1), b.column(2).to_pylist()):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if marked:
                    gone = np.zeros(n + 1, np.int64)
                    for s in marked:
                        gone[s["first"]] += 1
                        gone[s["first"] + s["n"] - 1 + WINDOW] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()]
                out_n.append(n)
                out_gone.append(n - len(words))
                out_kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out_n, pa.int64()), pa.array(out_gone, pa.int64()), pa.array(out_kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, as a digest of the words kept."""
    docs = table(spark, sf_dir, "documents")
    kept = without_spans(docs, repeated_spans(docs, "doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
 h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
 f AS (SELECT k, min(doc_id) AS keeper FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
 m AS (SELECT h.doc_id, h.i FROM h JOIN f USING (k) WHERE h.doc_id > f.keeper),
 c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS j FROM m)),
 g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
 r AS (SELECT d.doc_id, d.w, coalesce(g.js, []) AS js FROM d LEFT JOIN g USING (doc_id)),
 e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
 t AS (SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN c USING (doc_id, j) WHERE c.j IS NULL GROUP BY e.doc_id)
SELECT r.doc_id, CAST(len(r.w) AS BIGINT) AS n_words, CAST(len(r.js) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM r LEFT JOIN t USING (doc_id)
"""
