"""Vectorised text kernels over Arrow string columns: words, span hashes, sliding minima.

Texts stay in one UTF-8 buffer; no Python string is made per word.  A word is a maximal run of bytes
other than 0x20 and 0x09-0x0D, which on UTF-8 equals the regular expression ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 2 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after every other, never a source

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE = stream(11, 256)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
COEFF = stream(12, 64) | U64(1)
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[int(base)] = np.cumprod(have, dtype=U64)
    return _powers[int(base)][:n]


class Spans:
    """Hashes of any byte spans of a buffer, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = BYTE):
        n = len(buf)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(table[buf] * _pow(_BASE, n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= _pow(_INVERSE, len(self.sums))[starts]
        h += (ends - starts).astype(U64) * U64(0xA0761D6478BD642F)
        return mix(h)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings of the buffer, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        h = self.sums[k:] - self.sums[:n]
        h *= _pow(_INVERSE, n)
        return mix(h)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(), np.int64)


def slices(buf: np.ndarray, offs: np.ndarray, most: int = BLOCK, most_docs: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `most` bytes, and of at most most_docs: (first, last + 1, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, min(n, i + most_docs, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def hashes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each text."""
    out = [np.zeros(0, U64)]
    for _, _, part, at in slices(buf, offs, 1 << 20):
        out.append(Spans(part)(at[:-1], at[1:]))
    return np.concatenate(out)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each document (with the total at the end)."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * COEFF[0]
    for j in range(1, k):
        out += h[j : j + n] * COEFF[j]
    return mix(out)


def within(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n starts lie in one document together with the k - 1 that follow."""
    ok = np.ones(max(0, n), bool)
    if n <= 0:
        return ok
    for j in range(1, k):
        cut = bounds[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    # an empty document's bound repeats its neighbour's, which does no harm
    return ok


def slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(v) < w:
        return v[:0]
    size, m = 1, v
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(v) - w + 1], m[w - size :])


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
