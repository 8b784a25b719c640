"""A Bloom filter of ids, built without gathering the ids anywhere.

Executors build its pages with bitmap aggregates; the driver sees the finished pages and broadcasts them: sixteen bits an id, and
2**MOST bits (32 MB) at most, which the caller must keep to (``fits``). It never loses an id; it lets a few others through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext

U64 = np.uint64
LEAST, MOST, _PAGE = 18, 28, 32768
_SALTS = [0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B]


def fits(count: int) -> bool:
    """Whether a filter of so many ids lets no more than a few in a hundred others through."""
    return count <= (1 << MOST) // 8


def bits_for(count: int) -> int:
    return min(MOST, max(LEAST, (16 * max(1, count) - 1).bit_length()))


def positions(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id, a row an id."""
    h = np.asarray(ids).astype(np.int64).view(U64)
    return np.stack([(bytetext.mix(h ^ U64(salt)) >> U64(64 - bits)).astype(np.int64) for salt in _SALTS], axis=1)


class IdFilter:
    """Built from a DataFrame with a column of long ids, of which there are ``count``."""

    def __init__(self, ids: DataFrame, ident: str, count: int):
        self.bits = bits = bits_for(count)

        def places(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(positions(b.column(0).to_numpy(zero_copy_only=False), bits).reshape(-1))], names=["p"])

        at = ids.select(F.col(ident).cast("long")).mapInArrow(places, "p long")
        pages = at.groupBy(F.floor(F.col("p") / _PAGE).alias("page")).agg(F.expr(f"bitmap_construct_agg(p % {_PAGE})").alias("bitmap"))
        whole = np.zeros((1 << bits) // _PAGE * (_PAGE // 8), np.uint8)
        for page, bitmap in pages.collect():
            whole[page * (_PAGE // 8) : (page + 1) * (_PAGE // 8)] = np.frombuffer(bytes(bitmap), np.uint8)
        self.held = ids.sparkSession.sparkContext.broadcast(whole)

    def contains(self, ids: np.ndarray) -> np.ndarray:
        """For each id whether all its bits are set."""
        at = positions(ids, self.bits)
        return ((self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
