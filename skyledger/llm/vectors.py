"""Packing of embedding vectors into bytes, one way for all vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists of numbers: all numbers as double (null is NaN), where each list begins, and ends."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    begin, end = offsets[:-1], offsets[1:].copy()
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return values, begin, np.where(missing, begin, end)


def matrix(blobs: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max((len(b) for b in blobs), default=0)
    if all(len(b) == width for b in blobs):
        return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), width // np.dtype(kind).itemsize)
    return np.frombuffer(b"".join(b.ljust(width, b"\0") for b in blobs), kind).reshape(len(blobs), -1)


#: Scaled components beyond this, either way, stop there; so sums with an offset stay longs.
FARTHEST = 1 << 62


def floored(column: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold a vector of finite components, floor(factor * component) of those as longs).

    Shorter vectors end in zeros; the product is that of doubles.
    """
    values, begin, end = lists(column)
    unfit = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = ~column.is_null().to_numpy(zero_copy_only=False) & (unfit[end] == unfit[begin])
    begin, lengths = begin[kept], (end - begin)[kept]
    out = np.zeros((len(begin), int(lengths.max(initial=0))))
    row = np.repeat(np.arange(len(begin)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        out[row, place] = np.floor(values[np.repeat(begin, lengths) + place] * factor)
    return kept, np.clip(out, -FARTHEST, FARTHEST).astype(np.int64)


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows with zeros at their ends up to `width`."""
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
