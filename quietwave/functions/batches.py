"""Arrow list columns as NumPy blocks of equally long rows, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def blocks(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows x length block) per trace length; null rows are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths[valid]):
        rows = np.nonzero(valid & (lengths == n))[0]
        if len(rows) == len(lengths):
            block = values[offsets[0]:offsets[-1]].reshape(len(rows), n)
        else:
            block = values[offsets[rows][:, None] + np.arange(n)]
        out.append((rows, block))
    return out


def lists_of(count: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A list column of `count` rows from row numbers and blocks; rows without a block are null."""
    lengths, covered = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=bool)
    for rows, block in parts:
        lengths[rows], covered[rows] = block.shape[1], True
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.empty(offsets[-1])
    for rows, block in parts:
        if len(rows) == count:
            values = np.ascontiguousarray(block, dtype=float).reshape(-1)
        else:
            values[offsets[rows][:, None] + np.arange(block.shape[1])] = block
    mask = None if covered.all() else pa.array(~covered)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def on_blocks(lists: pa.Array, job: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Apply a rows x length job to every block of a list column."""
    return lists_of(len(lists), [(rows, job(block) if block.size else block) for rows, block in blocks(lists)])
