"""Words of Arrow texts as spans of bytes: hashes that hold for words of any length, and
texts put together again from chosen words."""

from __future__ import annotations

import hashlib

import numpy as np

from . import textbytes as tb

U = np.uint64
#: longer words are hashed one by one: sums of powers modulo 2^64 are weak on long regular bytes
LONG_WORD = 64
#: words whose bytes are copied at once
WORDS_AT_ONCE = 1 << 15


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    out = tb.span_hash(tb.prefix_sums(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def copied(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes, each followed by one space, and the offsets of the spans in them."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    if len(data):
        at = np.arange(len(out)) + np.repeat(starts - to[:-1], size)
        inside = np.ones(len(out), bool)
        inside[to[1:] - 1] = False
        out[inside] = data[at[inside]]
    return out, to


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The spans with one space between, put together in bounded blocks."""
    return b"".join(copied(data, starts[k : k + WORDS_AT_ONCE], ends[k : k + WORDS_AT_ONCE])[0].tobytes() for k in range(0, len(starts), WORDS_AT_ONCE))[:-1]
