"""Vectorised text primitives over Arrow string batches, shared by the corpus operators.

Documents come as Arrow arrays. They are walked in chunks of about a megabyte of UTF-8, a
document at a time when one is longer, so that a worker's memory does not depend on how many
rows Spark puts in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

# White space of the word rule: space and U+0009 to U+000D. Upper-case A-Z map to lower case.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (xor-shift and multiply rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, rows - rows[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``size`` bytes."""
    raw, rows = string_buffers(column)
    at, n = 0, len(rows) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + size, "right")) - 1)
        yield at, to, raw[rows[at] : rows[to]], rows[at : to + 1] - rows[at]
        at = to


def word_bounds(raw: np.ndarray, rows: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-space bytes (of bytes that are no ``separator``)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[raw]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= edge[1:-1] | ~inside[:-1]
    closes[:-1] &= edge[1:-1] | ~inside[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(rows, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span, by prefix sums of a polynomial mod 2**64."""
    if len(start) == 0:
        return np.zeros(0, U64)
    n = len(raw)
    sums = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _power_table(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power_table(_BASE_INVERSE, n)[start]
    return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (of the A-Z lower-cased word), row, start and end of every word of a chunk."""
    low = LOWER[raw]
    start, end, row = word_bounds(raw, rows)
    return span_hashes(low, start, end), row, start, end


def row_slices(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's entries in arrays sorted by row."""
    return np.searchsorted(row, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)
