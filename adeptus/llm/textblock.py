"""Vectorised tokenising of Arrow text columns (a task-side helper).

An Arrow string column already is one UTF-8 buffer with offsets.  The helper
views that buffer as bytes, marks token borders for all rows at once and
hashes every token with a handful of numpy passes, so no Python object is
made per word.

A *word* is a maximal run of ``0-9``, ``a-z`` (after lowering ``A-Z``) and
non-ASCII bytes.  A *symbol* token is a maximal run of other printable
characters.  White space and control characters separate tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, WORD, SYMBOL = 0, 1, 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CLASS = np.full(256, SYMBOL, dtype=np.uint8)
CLASS[:33] = SPACE
CLASS[127] = SPACE
CLASS[48:58] = WORD
CLASS[97:123] = WORD
CLASS[128:] = WORD

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """``POWER**0 .. POWER**(n-1)`` modulo 2**64."""
    out = np.full(max(n, 1), POWER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class TextBlock:
    """Tokens of rows ``lo:hi`` of a text column.

    ``start``/``length`` byte position and size of each token in ``buf``,
    ``hash`` its 64-bit hash, ``first[d]:first[d+1]`` the tokens of row d,
    ``doc`` the row of each token.
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lo: int, hi: int, symbols: bool = False):
        base = offsets[lo]
        self.rows = hi - lo
        self.offsets = offsets[lo:hi + 1] - base
        self.buf = LOWER[raw[base:offsets[hi]]]
        n = len(self.buf)
        kind = CLASS[self.buf]
        if not symbols:
            kind[kind == SYMBOL] = SPACE
        fresh = np.empty(n, bool)
        if n:
            fresh[0] = True
            np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
            inner = self.offsets[:-1]
            fresh[inner[inner < n]] = True
        inside = kind != SPACE
        self.start = np.flatnonzero(fresh & inside)
        at = np.flatnonzero(inside)
        if len(self.start):
            token = np.searchsorted(at, self.start)
            self.length = np.diff(np.append(token, len(at)))
            place = np.arange(len(at)) - np.repeat(token, self.length)
            value = BYTE_KEY[self.buf[at]] * powers(int(self.length.max()))[place]
            self.hash = mix(np.add.reduceat(value, token))
        else:
            self.length = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first token) of every ``size`` consecutive tokens of a row.

        A row with fewer tokens has one shingle of all its tokens; a row
        without tokens has none.
        """
        n = np.diff(self.first)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        total = int(count.sum())
        row = np.repeat(np.arange(self.rows), count)
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = self.first[row] + nth
        end = self.first[row + 1]
        out = np.zeros(total, np.uint64)
        padded = np.append(self.hash, np.zeros(size, np.uint64))
        for k in range(size):
            part = padded[at + k]
            if k:
                part[at + k >= end] = 0
            out = out * POWER + part
        return mix(out), row, at


def text_hash(name: str) -> int:
    """Hash of one token as :class:`TextBlock` computes it (``name`` is lower case)."""
    raw = np.frombuffer(name.encode(), np.uint8)
    value = BYTE_KEY[raw] * powers(len(raw))
    return int(mix(np.array([value.sum(dtype=np.uint64)], np.uint64))[0])


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[d]:first[d+1]]`` for each d; 0 for empty ranges."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full])      # a range's sum doesn't depend on its neighbours
    return out
