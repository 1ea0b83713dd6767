"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Everything is
vectorised over slices of half a MB, so a task's memory does not grow with its
share of the rows; one text is always whole in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Work arrays take up to 60 bytes for each byte of a slice.
SLICE_BYTES = 1 << 19
_BLOCK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)


class Texts(NamedTuple):
    """Rows ``first`` to ``first + len(ptr) - 2`` of a batch: the bytes of text
    ``i`` are ``buf[ptr[i]:ptr[i + 1]]``."""
    first: int
    buf: np.ndarray
    ptr: np.ndarray


class Words(NamedTuple):
    """Byte spans of all words, and the first word of every text."""
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Consecutive texts of a string column, about ``limit`` bytes at a time;
    a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ptr = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield Texts(i, buf[ptr[i]:ptr[j]], ptr[i:j + 1] - ptr[i])
        i = j


def split(t: Texts) -> Words:
    n = len(t.buf)
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[n + 1] = False
    np.logical_not(_SPACE[t.buf], out=solid[1:n + 1])
    body = solid[1:n + 1]
    first = body & ~solid[:n]
    last = body & ~solid[2:]
    inner = t.ptr[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = body[inner]           # a text ends its last word
    last[inner - 1] = body[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, t.ptr))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = pow(int(_P), -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        _tables[base] = _powers(base, max(n, _BLOCK + 4096))
    return _tables[base][:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (ascending, not overlapping): a
    polynomial in the bytes, by running sums over blocks of whole spans."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        lo, hi = start[i], end[j - 1]
        b = buf[lo:hi]
        if lower:
            b = _LOWER[b]
        run = np.empty(hi - lo + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _table(int(_P), hi - lo), out=run[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (run[e] - run[s]) * _table(_INVERSE, hi - lo + 1)[s]
        i = j
    return mix(out ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(48)))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries of ``h``."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[j:j + n]
    return mix(out)


def inside(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``k`` consecutive words lie in one text."""
    n = int(ptr[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    out = np.ones(n, dtype=bool)
    cuts = ptr[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < int(ptr[-1]))]
    for j in range(1, k):
        at = cuts - j
        out[at[(at >= 0) & (at < n)]] = False
    return out


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(h.view(np.int64))


def set_digests(h: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of ``n`` entries that ends at ``ends``, whatever the order in it."""
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)), out=run[1:])
    return mix(run[ends] - run[ends - n] + n.astype(np.uint64))
