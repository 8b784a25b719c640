"""Vectorised work on the UTF-8 bytes of text columns: words, word hashes, hashes of runs of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions take whole texts; long inputs
are worked through in segments, so temporary arrays stay small however long a text is.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 18
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: An odd base, its inverse modulo 2**64, and two odd multipliers.
_BASE, _A, _B = 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(32))) * U64(_A)
    x = (x ^ (x >> U64(29))) * U64(_B)
    return x ^ (x >> U64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row (plus one) the index of its first word.

    separator tells for each byte value whether it stands between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~separator[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads], last[tails] = solid[heads], solid[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: range) -> list[np.ndarray]:
    """For each length the hashes of the words' first bytes (0 where a word is not longer); equal to word_hashes of these bytes."""
    out = []
    for n in lengths:
        long = np.flatnonzero(ends - starts > n)
        h = np.zeros(len(starts), U64)
        h[long] = word_hashes(data, starts[long], starts[long] + n)
        out.append(h)
    return out


def _long_word(word: np.ndarray) -> int:
    total = 0
    for k in range(0, len(word), SEGMENT):
        part = word[k : k + SEGMENT]
        total += int(((part.astype(U64) + U64(1)) * _POWER[: len(part)]).sum(dtype=U64)) * pow(_BASE, k, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the bytes, read off running sums, then mixed."""
    out, lo = np.empty(len(starts), U64), 0
    while lo < len(starts):
        hi = int(np.searchsorted(ends, starts[lo] + SEGMENT, "right"))
        if hi == lo:
            out[lo] = _long_word(data[starts[lo] : ends[lo]])
            lo += 1
            continue
        a, b = starts[lo], ends[hi - 1]
        run = np.zeros(b - a + 1, U64)
        np.cumsum((data[a:b].astype(U64) + U64(1)) * _POWER[: b - a], out=run[1:])
        at = starts[lo:hi] - a
        out[lo:hi] = (run[ends[lo:hi] - a] - run[at]) * _INVERSE[at]
        lo = hi
    return mix(out + (ends - starts).astype(U64) * U64(_A))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two adjoining runs."""
    return mix(left * U64(_B) + right)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words, by doubling; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    level, size, out, done = words, 1, None, 0
    while True:
        if k & size:
            out = level[:n] if out is None else join_hashes(out[:n], level[done : done + n])
            done += size
        if done == k:
            return out
        level, size = join_hashes(level[:-size], level[size:]), 2 * size


def sequence_hash(words: np.ndarray, salt: int = 0) -> int:
    """A hash of a whole sequence of any length."""
    if not len(words):
        return salt
    place = mix(np.arange(1, len(words) + 1, dtype=U64) * U64(_A) + U64(salt))
    return int(mix(np.array([mix(words * (place | U64(1))).sum(dtype=U64) + U64(len(words))], U64))[0])


def spans_rows(first: np.ndarray) -> np.ndarray:
    """For each word the index of its row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
