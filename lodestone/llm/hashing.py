"""Words and word windows of Arrow text batches as 64-bit hashes, with numpy over whole batches.

A word is a run of bytes other than space and \\x09-\\x0D, so UTF-8 needs no decoding. A word's value is
a polynomial in its bytes, modulo 2**64, got from prefix sums and finished by a mixing function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STRETCH = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch with up to about ``limit`` bytes of text each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.frombuffer(col.fill_null("").cast(pa.large_binary()).buffers()[1], np.int64)[: len(col) + 1]
    start = 0
    while start < len(col):
        end = max(start + 1, int(np.searchsorted(size, size[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges are in order and don't overlap."""
    out, k = np.empty(len(start), U), 0
    while k < len(start):  # stretches that stay in the cache; a range is never split
        low = start[k]
        m = max(k + 1, int(np.searchsorted(end, low + _STRETCH, "right")))
        stretch, first, last = data[low : end[m - 1]], start[k:m] - low, end[k:m] - low
        sums = np.zeros(len(stretch) + 1, U)
        np.cumsum((stretch.astype(U) + U(1)) * _power(_BASE, len(stretch)), out=sums[1:])
        value = (sums[last] - sums[first]) * _power(_INVERSE, len(stretch) + 1)[first]
        out[k:m] = mix(value + (last - first).astype(U) * U(0xD6E8FEB86659FD93))
        k = m
    return out


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct values each one is, and those in order of first occurrence."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


class Tiles:
    """Ranges that cover texts end to end, from each byte that ``begins`` one and from each text's start on.

    ``first`` has each text's first range (rows + 1); ``of`` says which of the distinct ranges each range is,
    and ``words`` are the distinct ranges' bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray):
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        self.first = np.searchsorted(start, offsets)
        self.of, distinct = numbered(range_hashes(data, start, end))
        at = np.empty(len(distinct), np.int64)
        at[self.of[::-1]] = np.arange(len(start))[::-1]
        raw = data.tobytes()
        self.words = [raw[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, end to end."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, with room for n entries."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class Words:
    """Words of some texts: ``start``/``end`` byte positions, ``hash`` and ``first`` (rows + 1 word offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, lower: bool = False):
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        inside = ~_SEP[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = range_hashes(self.data, self.start, self.end)

    def every(self, length: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each position on, over the ends of texts too."""
        n = max(0, len(self.hash) - length + 1)
        total = np.full(n, salt * 0x632BE59BD9B4E019 & (1 << 64) - 1, U)
        for k in range(length):
            total += self.hash[k : k + n] * _factor(k + 31 * salt)
        return mix(total)

    def whole(self, length: int) -> np.ndarray:
        """Positions from which ``length`` words lie in one text."""
        n = max(0, len(self.hash) - length + 1)
        return np.flatnonzero(self.rows[:n] == self.rows[length - 1 :][:n])

    def windows(self, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word with a full window, and the words' positions."""
        at = self.whole(length)
        return self.every(length, salt)[at], at


def _factor(k: int) -> np.uint64:
    x = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return U((x ^ x >> 27) | 1)


def words_of(column: pa.Array | pa.ChunkedArray, *, lower: bool = False) -> Words:
    return Words(*utf8(column), lower=lower)
