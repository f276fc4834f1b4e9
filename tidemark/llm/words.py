"""Words of UTF-8 text as 64-bit hashes, computed on whole Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash depends on its bytes
alone, so it is the same in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GROUP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE = U(0xD1342543DE82EF95)
_powers = np.ones(256, U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n or _powers[1] == 1:
        grown = np.full(max(n, 256), _BASE, U)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=U)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of each row of a string column; null reads as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 18):
    """Ranges of rows of about ``most`` bytes, one row at least: what is computed for them fits in the processor's caches."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word. ``cuts``: positions where a word ends even without white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    edge = np.zeros(len(data) + 1, np.int8)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    del edge
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _GROUP, "right")))
        lo, hi = starts[at], ends[to - 1]
        sizes = ends[at:to] - starts[at:to]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        value = _BYTE[data[lo:hi][inside[lo:hi]]]
        value *= _power(int(sizes.max()) + 1)[place]
        hashes[at:to] = mix(np.add.reduceat(value, begin))
        at = to
    return starts, hashes


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
