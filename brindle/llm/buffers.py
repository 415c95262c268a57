"""Arrow string columns as numpy byte buffers, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of up to `most` bytes, or one longer row.

    Nulls count as empty. offsets start at 0 and have one entry more than rows.
    """
    arr = batch.column(column)
    if not (pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)):
        arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i+1]]; empty segments give 0."""
    if len(values) == 0:
        return np.zeros((len(offs) - 1, *values.shape[1:]), values.dtype)
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


#: Bytes that end a word: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses a row's end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ~IS_SPACE[buf]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    inner = offs[1:-1]
    cut = inner[(inner > 0) & (inner < len(buf))]
    first[cut] = letter[cut]
    last[cut - 1] = letter[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
