"""Numpy kernels over the bytes of an Arrow column of texts, shared by the operators.

All of them work on the one buffer that holds a batch's texts back to back, so their cost is
per byte and not per row. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Base of the polynomial hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Modulus and base of a second one.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_103_515_245
#: A batch is worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 20

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and offsets so that text i is data[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `size` bytes together; no row is split or left out."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 1 << 30, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many rows and about so many bytes, one row at least; memory in use is given back between them.

    What a worker copies then depends on `size` and not on the batches that Spark sends.
    """
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(batch.nbytes, 1)))
        for first in range(0, len(batch), step):
            yield batch.slice(first, step)
        del batch
        give_back()
    _powers.cache_clear()
    _prime_powers.cache_clear()
    give_back()


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries than glibc
    _trim = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)):
        powers = np.ones(1, np.uint64)
        while len(powers) < n:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), PRIME)) % np.uint64(PRIME)])
        out.append(powers[:n])
    return out[0], out[1]


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(PRIME)


class SpanHash:
    """Hashes of any spans of a sequence of bytes or numbers, in constant time each; equal spans, equal hashes.

    `of` is a polynomial modulo 2**64; `other` one modulo a prime, which has nothing in common with it.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.room = max(1 << 16, 1 << int(len(data) + 1).bit_length())
        self.up, self.down = _powers(self.room)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])
        self.rest: np.ndarray | None = None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Scattered bits of every span of so many symbols, for orders; cheaper than `of` and not equal to it."""
        out = self.sums[width:] - self.sums[: len(self.sums) - width]
        out *= self.down[: len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        return out

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        prime = np.uint64(PRIME)
        up, down = _prime_powers(self.room)
        if self.rest is None:
            self.rest = np.zeros(len(self.data) + 1, np.uint64)
            if self.data.dtype == np.uint8:
                terms = BYTE_SYMBOLS[self.data]
            else:
                terms = mix(self.data.astype(np.uint64) + np.uint64(1)) & prime
            terms *= up[: len(terms)]
            # below 2**32 and equal modulo the prime, so sums of up to 2**31 of them don't overflow
            np.cumsum((terms & prime) + (terms >> np.uint64(31)), out=self.rest[1:])
        return mix((self.rest[end] - self.rest[start]) % prime * down[start] % prime + np.uint64(1))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run without SPACE bytes, never over two rows."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of `width` words, ordered by row, then hash.

    A-Z count as a-z. A row with fewer words has its whole word sequence as one shingle; a row
    without words has none.
    """
    data = LOWER[data]
    start, end, row = words(data, offsets)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = SpanHash(data).of(start, end)
    n = len(word)
    total = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    for k in range(width):
        after = np.arange(n) + k
        inside = after < n
        after = np.minimum(after, n - 1)
        inside &= row[after] == row
        whole = inside
        total = total * np.uint64(0x9DDFEA08EB382D69) + np.where(inside, word[after] + np.uint64(1), np.uint64(0))
    first = np.r_[True, row[1:] != row[:-1]]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    use = whole | (first & (counts[row] < width))
    row, total = row[use], mix(total[use])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (total[1:] != total[:-1])]
    return row[new], total[new]


def fixed_binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as a binary Arrow column, null where not valid; `rows` are those of the valid ones."""
    width = rows.shape[1]
    sizes = np.full(len(rows), width) if valid is None else np.where(valid, width, 0)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array(valid, pa.bool_()).buffers()[1] if valid is not None else None
    return pa.Array.from_buffers(pa.binary(), len(sizes), [mask, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in an ordered array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))
