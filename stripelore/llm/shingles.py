"""Word shingles as 64-bit hashes, worked out on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are taken in pieces of about so many bytes; one text is never cut.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows of a string column; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text): words as in common.WORD, A-Z lower-cased."""
    n = len(raw)
    at = np.zeros(len(offsets), np.int64)
    if not n:
        return np.zeros(0, np.uint64), at
    low = _LOWER[raw] if lower else raw
    solid = ~_SPACE[raw]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    fresh[edges] = solid[edges]
    starts = np.flatnonzero(fresh)
    at[:] = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    which = np.cumsum(fresh) - 1
    place = np.arange(n) - starts[np.maximum(which, 0)]
    place[~solid] = 0
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    terms = (low.astype(np.uint64) + np.uint64(1)) * powers[place]
    terms[~solid] = 0
    return mix64(np.add.reduceat(terms, starts)), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text, ascending; with fewer words the whole sequence is one."""
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(_BASE) + words[j : j + len(rolled)]
    rolled = mix64(rolled + np.uint64(k))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = 0
            for w in words[a:b]:
                h = (h * _BASE + int(w)) & 0xFFFFFFFFFFFFFFFF
            out.append(mix64(np.array([(h + int(b - a)) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
