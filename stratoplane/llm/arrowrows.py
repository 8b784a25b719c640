"""Helpers for Arrow map functions."""

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of results after which a map function hands over a batch, and bytes of rows that Spark hands to one at a time.
BATCH_BYTES, TAKEN_BYTES = 8 << 20, 4 << 20
_KEPT: dict[str, Any] = {}


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session told to hand rows to Python in batches of at most TAKEN_BYTES (or one longer row).

    The session's own limit counts 10,000 rows, whatever their length, and 64 MB, of which a task holds several copies."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key, "67108864")).removesuffix("b")
    if not now.isdigit() or int(now) > TAKEN_BYTES:
        conf.set(key, str(TAKEN_BYTES))
    return df


def kept(key: str | None, make: Callable[[], Any] = dict) -> Any:
    """What the tasks of one operator share in a Python worker. A worker that turns to another operator (or None) drops it."""
    if key not in _KEPT:
        _KEPT.clear()
        if key is None:
            return None
        _KEPT[key] = make()
    return _KEPT[key]


def map_rows(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], Iterator[tuple]], weigh: Callable[[tuple], int] = lambda row: 64) -> DataFrame:
    """Apply rows to each Arrow batch; its tuples become rows of schema, handed over in batches of about BATCH_BYTES."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for b in batches:
            for row in rows(b):
                out.append(row)
                size += weigh(row)
                if size >= BATCH_BYTES:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return bounded(df).mapInArrow(run, schema)
