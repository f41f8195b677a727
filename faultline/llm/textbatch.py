"""Vectorized views of Arrow text columns: bytes, words and word hashes.

Words are runs of bytes without separators, so a batch is handled by table look-ups and segment sums over its UTF-8
bytes, without a Python object per word. Work is done in windows of 256 KB; only figures per word stay.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are neither letter nor digit; bytes from 128 belong to words.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POSITIONS = 64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, _POSITIONS * 256, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Uint64 values with all bits mixed (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of the rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of the words; a row's end also ends a word."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of integers between neighbouring offsets, also of empty segments."""
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return running[offsets[1:]] - running[offsets[:-1]]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words. Each byte at each place has a random summand, so only chance collides: for V distinct
    words with a probability of about V * V / 2**65 (3e-6 for ten million)."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + WINDOW, "right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        begin, size = starts[first:last] - low, ends[first:last] - starts[first:last]
        chars = LOWER[data[low:high]] if lower else data[low:high]
        at = np.arange(high - low, dtype=np.int32)
        at -= np.repeat(begin.astype(np.int32), np.diff(begin, append=high - low))
        values = _TABLE.take(((at & (_POSITIONS - 1)) << 8) | chars)
        if size.max() > _POSITIONS:
            # Only the bytes behind: a word's hash must not depend on the words beside it.
            far = np.flatnonzero(at >= _POSITIONS)
            values[far] = mixed(values[far] * (2 * (at[far] // _POSITIONS) + 1).astype(np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        sums = running[begin + size] - running[begin]
        out[first:last] = mixed(sums + size.astype(np.uint64))
        first = last
    return out
