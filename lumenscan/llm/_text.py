"""Vectorised words and hashes of whole texts.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Hashes have 64 bits: a polynomial over
the bytes, taken from one running sum for a whole slice of documents, then mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: So many bytes at a time: their arrays of 64-bit numbers stay in a core's cache.
SLICE_BYTES = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 20), _P if kind == "up" else _P_INV)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


#: For comparing wording: ASCII punctuation separates words as white space does.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


_tables: dict[tuple[bool, bytes], tuple[bytes, bytes]] = {}


def _translations(lower: bool, space: np.ndarray) -> tuple[bytes, bytes]:
    """For bytes.translate, far faster than indexing: whether a byte belongs to a word; what it counts in the word's hash
    (separators nothing)."""
    key = (lower, space.tobytes())
    if key not in _tables:
        _tables[key] = (~space).tobytes(), np.where(space, 0, _LOWER if lower else _AS_IS).astype(np.uint8).tobytes()
    return _tables[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for groups of rows of about `limit` bytes; a long text is alone. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a slice: start and end byte, hash, and per document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, space: np.ndarray = _SPACE):
        n = len(data)
        raw = data.tobytes()
        words, values = _translations(lower, space)
        solid = np.frombuffer(raw.translate(words), bool)
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        # a word that reaches over a document's end is cut there
        inside = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        cuts = np.unique(inside[solid[inside] & solid[inside - 1]])
        self.data, self.offsets = data, offsets
        self.start, self.end = edges[::2], edges[1::2]
        if len(cuts):
            self.start, self.end = (np.sort(np.concatenate([x, cuts])) for x in (self.start, self.end))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashes:
            sums = np.frombuffer(raw.translate(values), np.uint8).astype(np.uint64)
            sums *= _power("up", n)
            np.cumsum(sums, out=sums)
            # separators count nothing, so the sum before a word is that at the end of the word before
            own = np.diff(sums[self.end - 1], prepend=np.uint64(0))
            own *= _power("down", n)[self.start]
            self.hash = mix(own + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words, for every start with n words after it (document ends not regarded)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : k + m]
    return mix(out)
