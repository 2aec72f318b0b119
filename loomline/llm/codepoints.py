"""Arrow string buffers as numpy code-point arrays, and back, one batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the batch in one array, and the row borders in it (rows + 1 entries).

    A null row is an empty row; callers keep the validity themselves.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not pa.types.is_string(values.type):
        values = values.cast(pa.string())
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if values.null_count:
        values = values.fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int32, n + 1, values.offset * 4).astype(np.int64)
    body = values.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint32), offsets
    if raw.max() < 0x80:
        return raw.astype(np.uint32), offsets
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return points, starts[offsets]


def from_code_points(points: np.ndarray, borders: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The strings whose code points lie between consecutive ``borders``; rows not ``valid`` are null."""
    width = np.ones(len(points), np.int64)
    width += points >= 0x80
    width += points >= 0x800
    width += points >= 0x10000
    at = np.concatenate(([0], np.cumsum(width)))
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = at[borders]
    large = offsets[-1] > 2**31 - 1
    array = (pa.LargeStringArray if large else pa.StringArray).from_buffers(
        len(borders) - 1, pa.py_buffer(offsets.astype(np.int64 if large else np.int32)), pa.py_buffer(data)
    )
    if valid is not None and not valid.all():
        array = pc.if_else(pa.array(valid), array, pa.scalar(None, array.type))
    return array


def row_of(borders: np.ndarray) -> np.ndarray:
    """For each code point the number of its row."""
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders))


def borders_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Row borders for code points whose (ascending) row numbers are ``rows``."""
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64)
