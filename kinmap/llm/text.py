"""Vectorised helpers for texts inside Arrow tasks: byte views, word spans and 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# Arrow buffers go back to the system when they are freed, not to a pool that idle workers keep.
pa.set_memory_pool(pa.system_memory_pool())

BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)

PAD = 64
BLOCK_BYTES = 2 << 20
#: Bytes that are no white space: [^\x20\x09-\x0D]
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xBF58476D1CE4E5B9)


def bounded(docs: DataFrame) -> DataFrame:
    """The same table, after its session is told to send texts to Python in batches of fewer rows and bytes."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def give_back() -> None:
    """Freed memory back to the system: workers live on after their tasks, and what they hold is missing elsewhere."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def tidy(function: Callable) -> Callable:
    """The function on batches, which gives freed memory back when its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def tidy_group(function: Callable) -> Callable:
    """The function on a key and its group, which gives freed memory back when it is done."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = function(key, group)
        del group
        give_back()
        return out

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * SECOND
    return x ^ (x >> np.uint64(32))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, padded bytes, offsets of the rows and the end) for runs of rows of about `limit` bytes.

    Null rows have no bytes. A single longer row is a block of its own.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, len(column))
        size = int(offsets[last] - offsets[row])
        padded = np.zeros(size + PAD, np.uint8)
        padded[:size] = data[offsets[row] : offsets[last]]
        yield row, last, padded, offsets[row : last + 1] - offsets[row]
        row = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of `inside` bytes; runs never cross rows."""
    size = int(offsets[-1])
    flags = np.zeros(size + 1, bool)
    flags[:size] = inside[:size]
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    edges = offsets[(offsets > 0) & (offsets < size)]
    begin[edges] = flags[edges]
    starts = np.flatnonzero(begin)
    stop = ~flags
    stop[edges] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def load64(padded: np.ndarray) -> np.ndarray:
    """The little-endian word at every byte (unaligned view; the pad makes the last ones valid)."""
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))


def span_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    lengths = ends - starts
    words = load64(padded)
    out = mixed(lengths.astype(np.uint64) + MULTIPLIER)
    at, k = np.flatnonzero(lengths <= PAD), 0
    while len(at):
        left = np.minimum(lengths[at] - k, 8).astype(np.uint64)
        mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        out[at] = mixed(out[at] ^ (words[starts[at] + k] & mask)) + MULTIPLIER
        k += 8
        at = at[lengths[at] > k]
    for j in np.flatnonzero(lengths > PAD):
        out[j] = xxhash.xxh64_intdigest(padded[starts[j] : ends[j]].tobytes())
    return out


def grouped_offsets(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows starts in the sorted `rows`, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane: the empty planes vanish in Spark's compression."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def word_hashes(padded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, A-Z lowered, and the row of each."""
    lowered = LOWER[padded]
    starts, ends, rows = spans(WORD_BYTE[lowered], offsets)
    return span_hashes(lowered, starts, ends), rows
