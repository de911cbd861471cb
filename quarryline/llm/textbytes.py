"""Vectorised words over Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words are runs of bytes that
are none of space, tab, line feed, vertical tab, form feed and carriage return
(those bytes never occur inside a longer UTF-8 character).  Everything here works
on numpy arrays over bounded pieces of a batch, so memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of letter runs: a-z and every byte of a character beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, U)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[kind] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about
    ``most`` bytes; a longer text is a piece of its own.  Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    rows = len(column)
    if not rows:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, rows + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true, cut at row bounds, and each row's first run."""
    starts = inside.copy()
    ends = inside.copy()
    if len(inside):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offsets))
        first, last = offsets[full], offsets[full + 1] - 1
        starts[first] = inside[first]
        ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums before each byte, for ``span_hash``."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", _BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes anywhere."""
    down = _power("down", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def hash_bytes(word: bytes) -> int:
    """``span_hash`` of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hash(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, and each row's first word's index."""
    low = LOWER[data]
    starts, ends, rows = runs(~SEPARATOR[data], offsets)
    return span_hash(prefix_sums(low), starts, ends), rows


_PLACE = np.array([0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of ``size`` consecutive words from each word on, row bounds ignored."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(size):
        out += hashes[k : k + n] * _PLACE[k % 5] * U(2 * (k // 5) + 1)
    return mix(out)


def shingle_set(hashes: np.ndarray, all_shingles: np.ndarray, lo: int, hi: int, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles of the row with words lo..hi; fewer words than
    ``size`` are one shingle, no words none."""
    n = hi - lo
    if n >= size:
        return np.unique(all_shingles[lo : hi - size + 1])
    if n == 0:
        return np.zeros(0, U)
    place = np.arange(1, n + 1, dtype=U)
    return mix(np.array([(hashes[lo:hi] * place * _PLACE[0]).sum(dtype=U) + U(n)], U))
