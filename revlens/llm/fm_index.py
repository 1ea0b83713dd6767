"""FM-index over word ids with a wavelet matrix, in numpy.

Suffixes are ordered by their first ``depth`` words, which is all that
searches of up to that many words need.  All operations take arrays, so many
searches advance together.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A packed bit vector with counts of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.word = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.word).astype(np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)[:-1]])
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.word[w] & mask)


class WaveletMatrix:
    """Rank of any symbol at any place, by one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, BitRank]] = []
        s = symbols
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> shift & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(bit)))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # Where the run of each symbol begins on the last level.
        self.base = np.searchsorted(_keys(s, self.levels), _keys(np.arange(sigma), self.levels)) if len(s) else np.zeros(sigma, np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for shift, bits in self.levels:
            one = bits.ones(at)
            at = np.where(symbol >> shift & 1, bits.zeros + one, at - one)
        return at - self.base[symbol]


def _keys(s: np.ndarray, levels: list) -> np.ndarray:
    """The order of the last level: by bits reversed, last bit first."""
    out = np.zeros(len(s), dtype=np.int64)
    for i, (shift, _) in enumerate(levels):
        out |= (s >> shift & 1).astype(np.int64) << i
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Index of ``text`` (symbols from 0, 0 being a separator at its end)."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        n = len(text)
        self.n, self.depth = n, depth

        def ahead(rank: np.ndarray, k: int) -> np.ndarray:
            """Ranks ``k`` places further on; nothing sorts before everything."""
            out = np.zeros(n, dtype=np.int64)
            if k < n:
                out[:n - k] = rank[k:] + 1
            return out

        def joined(rank: np.ndarray, other: np.ndarray) -> np.ndarray:
            return _dense(rank * (n + 2) + other)

        rank, have = _dense(text), 1
        while have * 2 <= depth - 1:
            rank = joined(rank, ahead(rank, have))
            have *= 2
        shorter = rank if have == depth - 1 else joined(rank, ahead(rank, depth - 1 - have))
        full = joined(rank, ahead(rank, depth - have))
        self.order = np.argsort(full, kind="stable")
        self.block = full[self.order]                 # rows that agree in ``depth`` words
        self.block_start = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1]))
        less = shorter[self.order]
        cut = np.append(True, less[1:] != less[:-1])
        self.less = np.cumsum(cut) - 1                # rows that agree in one word less
        edge = np.append(np.flatnonzero(cut), n)
        self.less_lo, self.less_hi = edge[:-1], edge[1:]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.bwt = WaveletMatrix(text[self.order - 1], sigma)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with a word put before the searched words."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of full depth without their last word; empty ones stay empty."""
        at = self.less[np.minimum(lo, self.n - 1)]
        full = hi > lo
        return np.where(full, self.less_lo[at], lo), np.where(full, self.less_hi[at], hi)

    def windows(self, words: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of every run of ``depth`` words of streamed passages: for
        passage ``i``, runs ``start[i]`` to ``start[i] + count[i] - 1`` of
        ``words`` (an unknown word is -1).  All passages advance together from
        their last run to their first; a search that fails starts anew."""
        place = np.concatenate([[0], np.cumsum(count)])
        out_lo, out_hi = np.zeros(place[-1], dtype=np.int64), np.zeros(place[-1], dtype=np.int64)
        run = start + count - 1
        active = np.arange(len(start))
        lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        while len(active):
            known = words[run]
            alive = (hi > lo) & (known >= 0)
            if alive.any():
                a, b = self.shorten(lo[alive], hi[alive])
                lo[alive], hi[alive] = self.extend(known[alive], a, b)
            anew = np.flatnonzero(~alive)
            if len(anew):
                a, b = np.zeros(len(anew), np.int64), np.full(len(anew), self.n)
                for k in range(self.depth - 1, -1, -1):
                    s = words[run[anew] + k]
                    a, b = self.extend(np.maximum(s, 0), a, b)
                    b = np.where(s >= 0, b, a)
                lo[anew], hi[anew] = a, b
            at = place[active] + run - start[active]
            out_lo[at], out_hi[at] = lo, hi
            more = run > start[active]
            active, run, lo, hi = active[more], run[more] - 1, lo[more], hi[more]
        return out_lo, out_hi

    def least(self, value: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The least ``value`` (one per place of the text) in full-depth
        intervals that begin at ``lo``."""
        best = np.minimum.reduceat(value[self.order], self.block_start)
        return best[self.block[lo]]
