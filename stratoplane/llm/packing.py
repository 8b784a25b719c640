"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are tokenised (ids of word_bpe_49k.json or another tokenizer file, then an end id) and cut into pieces of at most
CAPACITY tokens only where they are longer. Pieces are dealt by a hash to groups of about GROUP pieces, each packed by one task:

* best-fit decreasing: each piece goes to the open bin with the least room that still takes it;
* local search: between bins with room, documents are moved or exchanged one for one, two for one and one for two, whenever
  that increases the sum of squared fills, the emptiest bins giving first, until they are empty or no exchange helps. The
  sum is a bounded integer that only grows, so the search ends.

A group is bounded whatever the input's size, and every group holds the same mix of lengths, so few bins are lost to grouping. Pieces
are dealt by their place in the written table of pieces, so null or repeated ids do not gather in a group. Words are
tokenised once and remembered by each worker in tables of bounded bytes: the tokenizer never joins across white space.

Null and empty texts are one end id. Repeated rows are packed as often as they come, and so are rows without an id. Texts of any
length are cut into pieces one row at a time. Extra columns of the documents are ignored, those of pieces stay; columns named
sequence_id and offset are replaced. Empty tables give empty results.
"""

import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared_store import written
from ..tables import table
from .arrowrows import bounded, kept

CAPACITY, END_ID, GROUP = 2048, 0, 8192
#: Bytes of words, and as many of parts of words, that a worker remembers before its table starts anew; what an entry takes beside its text.
REMEMBERED, _ENTRY = 64 << 20, 160


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordTokens(dict):
    """The ids of words between ASCII white space, as little-endian 32-bit bytes.

    Words of printable ASCII and Latin letters are taken apart as the tokenizer does, and only their parts go through its merges;
    parts are remembered too. All other words, and all words for a tokenizer with other rules, go to the tokenizer whole."""

    _parts = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
    #: Anything else than printable ASCII and Latin letters, and beginnings of special tokens.
    _odd = re.compile("[^\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\\|")
    _rules = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), {}
        self.word_bytes = self.part_bytes = 0
        rules = str(self.tokenizer.pre_tokenizer)
        self.plain = str(self.tokenizer.normalizer).endswith("Lowercase()])") and self._rules in rules and "ByteLevel(add_prefix_space=False" in rules
        letters = _byte_letters()
        self.letters = {chr(b): "".join(letters[x] for x in chr(b).encode()) for b in range(0x80, 0x100)}

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        key = part if part.isascii() else "".join(self.letters.get(c, c) for c in part)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(key)])

    def __missing__(self, word: bytes) -> bytes:
        if self.word_bytes >= REMEMBERED:
            self.clear()
            self.word_bytes = 0
        text, parts = word.decode(), self.parts
        if self._odd.search(text) or not self.plain:
            out = self.whole(text)
        else:
            out = []
            for p in self._parts.findall(text.lower()):
                ids = parts.get(p)
                if ids is None:
                    if self.part_bytes >= REMEMBERED:
                        parts.clear()
                        self.part_bytes = 0
                    ids = parts[p] = self.part(p)
                    self.part_bytes += _ENTRY + len(p) + len(ids)
                out.append(ids)
            out = b"".join(out)
        if len(word) <= 256:
            self[word] = out
            self.word_bytes += _ENTRY + len(word) + len(out)
        return out


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) for each piece of every row."""
    kind, path = dict(docs.dtypes)[id_col], path or public_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = kept(f"words of {path}", lambda: WordTokens(path))
        for b in batches:
            out = []

            def batch():
                key, piece, start, length, crc, ids = zip(*out)
                columns = [pa.array(key, b.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                ids = b"".join([tokens[w] for w in words]) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                if len(out) >= 4096:
                    yield batch()
                    out = []
            if out:
                yield batch()

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return bounded(docs.select(id_col, text_col)).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of places in lengths. Rooms are bits of one integer, so the best is one bit operation away."""
    bins, by_room, rooms = [], [[] for _ in range(capacity + 1)], 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
            room -= need
        else:
            k, room = len(bins), capacity - need
            bins.append([i])
        by_room[room].append(k)
        rooms |= 1 << room
    return bins


def _exchange(a: list[int], b: list[int], room: int, least: int, length) -> tuple[list[int], list[int]] | None:
    """Documents to give from a and to take from b so that b gains most, at least ``least`` and at most its room: one for
    none, one for one, one for two or two for one."""
    best, found = least - 1, None
    gives = [([x], length[x]) for x in a] + [([x, y], length[x] + length[y]) for k, x in enumerate(a) for y in a[k + 1 :]]
    gives.sort(key=lambda g: g[1])
    sizes = [g[1] for g in gives]
    takes = [([], 0)] + [([x], length[x]) for x in b] + [([x, y], length[x] + length[y]) for k, x in enumerate(b) for y in b[k + 1 :]]
    for out, n in takes:
        k = bisect_right(sizes, n + room) - 1
        while k >= 0 and sizes[k] - n > best:
            if len(gives[k][0]) + len(out) <= 3:
                best, found = sizes[k] - n, (gives[k][0], out)
                break
            k -= 1
    return found


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over bins with room; every step increases the sum of squared fills."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least_bins = -(-sum(lengths) // capacity)
    alive = sum(1 for b in bins if b)
    givers = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: (fill[k], k))
    for giver in givers:
        if alive <= least_bins:
            break
        takers = sorted((k for k in givers if k != giver and bins[k] and fill[k] < capacity), key=lambda k: (-fill[k], k))
        spare = sum(capacity - fill[k] for k in takers)
        if not bins[giver] or spare < fill[giver]:
            continue
        moved = True
        while moved and bins[giver]:
            moved = False
            for k in takers:
                room = capacity - fill[k]
                # What the taker gains must exceed the lead of the giver, or squares would not grow.
                least = max(1, fill[giver] - fill[k] + 1)
                if room < least or not bins[giver]:
                    continue
                found = _exchange(bins[giver], bins[k], room, least, lengths)
                if not found:
                    continue
                give, take = found
                gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                bins[k] = [i for i in bins[k] if i not in take] + give
                bins[giver] = [i for i in bins[giver] if i not in give] + take
                fill[k], fill[giver], moved = fill[k] + gain, fill[giver] - gain, True
        if not bins[giver]:
            alive -= 1
    return [b for b in bins if b]


def packed(pieces: DataFrame, id_col: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be a written table (it is counted, then packed by the rows' places in it)."""
    groups = max(1, -(-pieces.count() // group))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kinds = ", ".join(f"`{c}` {k}" for c, k in pieces.select(names).dtypes)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([(id_col, "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        lengths = rows.column("length").to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = rows.column("_group")[0].as_py() << 32
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return rows.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    place = F.xxhash64(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), "_metadata.row_index")
    dealt = bounded(pieces).select(*names, place.alias("_row")).withColumn("_group", F.pmod("_row", F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, f"{kinds}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with the sequence and place that each is packed to."""
    return packed(written(token_pieces(table(spark, sf_dir, "documents"), "doc_id", "text"), "pieces"), "doc_id")
