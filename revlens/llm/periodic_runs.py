"""Periodic runs of words by descending-LCP Kruskal (operator 11).

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal) and at least ``max(min_length, 2 * q)`` words that no
neighbouring word extends keeping that period.

Positions of a text that share their next words form suffix classes.  The edges
between neighbours in suffix order are taken by decreasing common prefix (LCP),
and each unites two classes, kept as ordered position sets; the smaller set is
inserted into the larger.  Two positions that become neighbours in a set at a
distance ``p`` within the current LCP seed a run of period ``p``: had the
stretch a smaller period, a position between them would have been united
earlier.  A seed that no word extends to the left is a run; its length is ``p``
plus the LCP.  A run has at least ``min_length`` words, half of which at least
are common prefix, so edges under ``min_length / 2`` are never needed and
positions whose first words do not repeat in their text take no part.

Suffixes are ordered by doubling the compared length for the positions that are
not told apart yet, over slices of a few MB of whole texts; every text is one
row, so no shuffle takes place.

Defined cases: a null, empty or blank text has no words and no runs; a text of
any length is treated whole in one slice; rows that repeat and rows of one or
no id are treated row by row, each with its result; an empty table gives an
empty result; other columns are ignored, whatever their names.  Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship, tidy
from .words import Texts, gram_hashes, inside, mix, slices, span_hashes, split

MIN_LENGTH = 12
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FIELDS = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "collapsed string")


def _suffix_order(word: np.ndarray, left: np.ndarray, span: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """All positions in suffix order, and their ranks by their first ``span``,
    ``2 * span``, ... words.  ``word`` holds numbers from 1 on, ``left`` the
    count of words from a position to the end of its text.  Place ``n`` after
    the last position has a rank of its own."""
    n, bits = len(word), int(word.max()).bit_length()
    per = 62 // bits
    keys = []
    for lo in range(0, span, per):
        key = np.zeros(n, dtype=np.int64)
        for j in range(lo, min(span, lo + per)):
            key <<= bits
            key[:n - j] |= np.where(left[:n - j] > j, word[j:], 0)
        keys.append(key)
    todo = np.lexsort(keys[::-1])
    opens = np.zeros(n, dtype=bool)
    opens[0] = True
    for key in keys:
        opens[1:] |= key[todo[1:]] != key[todo[:-1]]
    rank = np.empty(n + 1, dtype=np.int32)
    rank[todo] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    rank[n] = n
    ranks, reach = [rank], span
    while True:
        todo = todo[~(opens & np.append(opens[1:], True))]       # told apart from all others: done
        if not len(todo):
            break
        old = rank[todo].astype(np.int64)
        pair = (old << 32) | rank[np.minimum(todo + reach, n)]
        by = np.argsort(pair, kind="stable")
        todo, pair, old = todo[by], pair[by], old[by]
        place = np.arange(len(todo))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        opens = np.append(True, pair[1:] != pair[:-1])
        rank = rank.copy()
        rank[todo] = old + np.maximum.accumulate(np.where(opens, place, 0)) - group
        ranks.append(rank)
        reach *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank[:n]] = np.arange(n)
    return suffixes, ranks


def _common(i: np.ndarray, j: np.ndarray, word: np.ndarray, ranks: list[np.ndarray], span: int) -> np.ndarray:
    """Common prefix of the suffixes ``i`` and ``j`` that share a gram."""
    n = len(word) - 1
    out = np.zeros(len(i), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        out += (r[np.minimum(i + out, n)] == r[np.minimum(j + out, n)]) * (span << level)
    same = np.ones(len(i), dtype=bool)
    for _ in range(span - 1):
        same &= word[np.minimum(i + out, n)] == word[np.minimum(j + out, n)]
        out += same
    return out


def _seeds(left: list[int], right: list[int], lcp: list[int], n: int) -> tuple[list[int], list[int], list[int]]:
    """Seeds (position, period, LCP) of the edges, given by descending LCP."""
    home: list[list[int] | None] = [None] * n
    starts: list[int] = []
    periods: list[int] = []
    commons: list[int] = []

    def seed(a: int, b: int, common: int) -> None:
        starts.append(a)
        periods.append(b - a)
        commons.append(common)

    for i, j, common in zip(left, right, lcp):
        big, small = home[i], home[j]
        if big is None:
            big = home[i] = [i]
        if small is None:
            small = home[j] = [j]
        if len(big) < len(small):
            big, small = small, big
        if len(small) == 1:
            x = small[0]
            k = bisect_left(big, x)
            if k and x - big[k - 1] <= common:
                seed(big[k - 1], x, common)
            if k < len(big) and big[k] - x <= common:
                seed(x, big[k], common)
            big.insert(k, x)
            home[x] = big
            continue
        if 8 * len(small) < len(big):
            for x in small:
                big.insert(bisect_left(big, x), x)
        else:
            big += small
            big.sort()              # two ordered runs: a merge
        k = 0
        for x in small:
            k = bisect_left(big, x, k)
            # Neighbours from the other set are newly adjacent.
            if k:
                y = big[k - 1]
                if x - y <= common and home[y] is big:
                    seed(y, x, common)
            if k + 1 < len(big):
                y = big[k + 1]
                if y - x <= common and home[y] is big:
                    seed(x, y, common)
        for x in small:
            home[x] = big
    return starts, periods, commons


def runs_of(word: np.ndarray, ptr: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start, then period.  ``word``
    holds 64-bit values of all words, text ``i`` being ``ptr[i]:ptr[i + 1]``;
    starts count from the first text."""
    none = (np.zeros(0, np.int64),) * 3
    span = max(1, min_length // 2)
    gram = gram_hashes(word, span)
    whole = np.flatnonzero(inside(ptr, span))
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    salt = mix(np.arange(1, len(ptr), dtype=np.uint64))
    shared = gram[whole] ^ salt[doc[whole]]
    by = np.argsort(shared, kind="stable")
    twice = by[1:][shared[by[1:]] == shared[by[:-1]]]
    if not len(twice):
        return none
    # Texts of which no gram repeats have no runs.
    repeats = np.zeros(len(ptr) - 1, dtype=bool)
    repeats[doc[whole[twice]]] = True
    place = np.flatnonzero(repeats[doc])
    doc = doc[place]
    own = np.unique(word[place] ^ salt[doc], return_inverse=True)[1] + 1     # words of two texts never agree
    left = ptr[doc + 1] - place
    suffixes, ranks = _suffix_order(own, left, span)
    own = np.append(own, 0)
    i, j = suffixes[:-1], suffixes[1:]
    near = ranks[0][i] == ranks[0][j]
    i, j = i[near], j[near]
    lcp = _common(i, j, own, ranks, span)
    order = np.argsort(-lcp, kind="stable")
    start, period, common = (np.array(x, dtype=np.int64) for x in
                             _seeds(i[order].tolist(), j[order].tolist(), lcp[order].tolist(), len(place)))
    if not len(start):
        return none
    length = period + common
    first = (start == 0) | (own[start - 1] != own[start + period - 1])
    keep = first & (length >= min_length)
    found = np.unique(np.stack([place[start[keep]], period[keep], length[keep]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _texts(t: Texts, min_length: int, rows: pa.Array) -> pa.RecordBatch:
    w = split(t)
    start, length, period = runs_of(span_hashes(t.buf, w.start, w.end), w.ptr, min_length)
    n_texts = len(t.ptr) - 1
    bounds = np.searchsorted(start, w.ptr)
    drop = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = np.cumsum(drop[:-1]) == 0
    raw, ptr = t.buf.tobytes(), t.ptr.tolist()
    collapsed = []
    for i in range(n_texts):
        words = raw[ptr[i]:ptr[i + 1]].split()          # ASCII white space: 0x20, 0x09-0x0D
        if bounds[i] < bounds[i + 1]:
            words = list(compress(words, kept[w.ptr[i]:w.ptr[i + 1]].tolist()))
        collapsed.append(b" ".join(words).decode("utf-8"))
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    runs = pa.StructArray.from_arrays(
        [pa.array(start - w.ptr[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(np.diff(w.ptr).astype(np.int64)),
         pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs).cast(_RUNS),
         pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, n_words, runs`` (structs of start, length and period, by
    start, then period) and ``collapsed``, the text without the words that a
    run repeats (all after its first period), joined by one space."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                yield _texts(t, min_length, b.column(0).slice(t.first, len(t.ptr) - 1))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), FIELDS)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period), null
    without runs, as a struct ``back`` (minus its length), ``start``, ``period``."""
    return F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"))))
