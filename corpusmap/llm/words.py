"""Words of a batch of texts as numpy arrays, straight from the Arrow buffers.

Nothing here loops over documents or words in Python: a batch is one array of bytes, its words
are ranges in it, and hashes are sums over those ranges. Words never cross documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values evenly; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


@lru_cache(maxsize=8)
def byte_table(seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte value, the same in every process."""
    return mix(np.arange(256, dtype=U64) + U64(seed * 1000 + 7))


_BASE = 0x9E3779B97F4A7C15
#: Bytes whose powers are held; those of further places are products with a power of this many.
_STEP = 1 << 16


@lru_cache(maxsize=4)
def _powers(n: int, base: int = _BASE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, base, U64)]), dtype=U64)


def _inverse_powers() -> np.ndarray:
    return _powers(_STEP, pow(_BASE, -1, 1 << 64))


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd number modulo 2**64: at least ``n`` of them."""
    return _powers(1 << max(10, int(n - 1).bit_length()))[:n]


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_mask() -> np.ndarray:
    """Bytes of letters and digits: 0-9, a-z and every byte of a non-ASCII character."""
    m = np.zeros(256, bool)
    m[48:58] = m[97:123] = m[128:] = True
    return m


def nonspace_mask() -> np.ndarray:
    """Bytes other than the blank and the control characters from tab to carriage return."""
    m = np.ones(256, bool)
    m[32] = False
    m[9:14] = False
    return m


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty. offsets has n + 1 entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``doc`` (row of each word), ``hash``, ``start`` (byte), and per row
    ``first`` (its first word; n + 1 entries)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, seed: int = 1):
        low = lower_table()
        keep = np.frombuffer(bytearray(data).translate(mask[low].tobytes()), bool)
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        edges = offsets[:-1][(offsets[:-1] < len(data))]
        begins[edges] = keep[edges]  # a document's first byte starts a word of its own
        ends = keep
        ends[:-1] &= ~keep[1:] | begins[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        with np.errstate(over="ignore"):
            value, total = byte_table(seed)[low], np.zeros(len(data) + 1, U64)
            for i, a in enumerate(range(0, len(data), _STEP)):
                part = value[data[a : a + _STEP]] * (powers(_STEP)[: len(data) - a] * U64(pow(_BASE, _STEP * i, 1 << 64)))
                np.cumsum(part, out=total[a + 1 : a + 1 + _STEP])
                total[a + 1 : a + 1 + _STEP] += total[a]
            # Sums begin at the power of the word's place; its inverse takes them back to the power 0.
            far = np.array([pow(_BASE, -_STEP * i, 1 << 64) for i in range(len(data) // _STEP + 1)], U64)
            back = far[self.start // _STEP] * _inverse_powers()[self.start % _STEP]
            self.hash = mix((total[self.end] - total[self.start]) * back + (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.hash)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words inside a row; shorter rows give one short run.

    Rows without words give none.
    """
    n = np.diff(first)
    rows = np.arange(len(n))
    total = len(hashes)
    out = np.zeros(total, U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            part = np.zeros(total, U64)
            part[: max(total - j, 0)] = hashes[j:]
            out = out * U64(0x9E3779B97F4A7C15) + mix(part + U64(j + 1))
        short = np.flatnonzero((n > 0) & (n < size))
        for row in short:  # a few words each
            h = U64(0)
            for w in hashes[first[row] : first[row + 1]]:
                h = mix(np.array([h + w + U64(size)], U64))[0]
            out[first[row]] = h
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(rows, count)
    begin = np.repeat(first[:-1], count) + (
        np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    )
    return mix(out[begin]), doc


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the number of each value among them)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[at], order[at], number


def row_slices(offsets: np.ndarray, limit: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    out, begin, n = [], 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        out.append((begin, end))
        begin = end
    return out
