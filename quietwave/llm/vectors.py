"""Embedding columns as integer vectors, and exact sums over their tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

# Entries stay below this, so that squares of differences of up to 64 dimensions fit a long.
LIMIT = 1 << 27
WHOLE = pa.decimal128(38, 0)


def as_block(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column without nulls as a rows x dims block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integer_vectors(df: DataFrame, keep: list[str], vector: str, dims: int, scale: float, out: str = "x") -> DataFrame:
    """The columns `keep` and floor(scale * entry) as an array of longs, entries taken as doubles.

    Rows go whose vector is null, has another length, or holds a null or non-finite entry. An entry of
    2^27 or more after scaling stops the job with an error, because distances would not fit a long.
    """
    schema = StructType([*[df.schema[c] for c in keep], StructField(out, ArrayType(LongType(), False))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            long_enough = lists.is_valid().to_numpy(zero_copy_only=False)
            long_enough[long_enough] = lists.drop_null().value_lengths().to_numpy() == dims
            rows = np.nonzero(long_enough)[0]
            entries = lists.take(pa.array(rows)).flatten().cast(pa.float64())
            block = entries.to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # a null entry becomes NaN
            usable = np.isfinite(block).all(axis=1)
            rows, block = rows[usable], np.floor(block[usable] * scale)
            if block.size and np.abs(block).max() >= LIMIT:
                raise ValueError(f"an entry of a vector is too large: {np.abs(block).max() / scale}")
            whole = pa.array(block.astype(np.int64).reshape(-1))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dims)
            kept = [c.take(pa.array(rows)) for c in batch.columns[:len(keep)]]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, whole)], names=[*keep, out])

    return df.select(*keep, vector).mapInArrow(convert, schema)


def per_task(df: DataFrame, columns: list[str], start: Callable[[], dict], add: Callable[..., None], finish: Callable[[dict], dict], schema: str) -> DataFrame:
    """One pass in which a task folds its batches into one state and gives rows only at its end."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                add(state, *batch.columns)
        columns_out = finish(state)
        yield pa.RecordBatch.from_arrays(list(columns_out.values()), names=list(columns_out))

    return df.select(*columns).mapInArrow(fold, schema)


def whole_lists(rows: list[list[int]]) -> pa.Array:
    """Lists of Python integers as an exact list column."""
    return pa.array(rows, pa.list_(WHOLE))


def summed(df: DataFrame, keys: list[str], lists: str) -> dict[tuple, dict[int, int]]:
    """Exact sums of lists place by place, per key. Meant for few keys: all sums come to the driver."""
    each = df.select(*keys, F.posexplode(lists).alias("_i", "_v"))
    rows = each.groupBy(*keys, "_i").agg(F.sum("_v").cast("decimal(38,0)").alias("_v")).collect()
    out: dict[tuple, dict[int, int]] = {}
    for row in rows:
        out.setdefault(tuple(row[k] for k in keys), {})[row["_i"]] = int(row["_v"])
    return out
