"""Document fingerprints by SimHash (operator 4).

Terms are runs of three words, weighted by their length in bytes up to a
limit (longer runs are rarer); their 128-bit hashes vote on signed bits.  Block
tables find all fingerprints within a Hamming radius r: every block has an
allowance of changed bits, and the allowances are so dealt that a pair within
the radius keeps to that of one block at least; a query looks its block up in
that table under every change within the allowance, so every pair meets.  The
number of tables follows the number of rows: more rows ask for fewer and wider
blocks, so that a block's key stays selective.  By the model of ``tables_for``
with radius 20 a query row costs about 2,600 probes and candidates among 2^18
rows, 38,000 among 2^24 and 460,000 among 2^30: it grows as about the 0.6th
power of the rows, not in proportion.

The query's radius ``NEAR`` is the expected distance at Jaccard similarity 0.8
of the terms, 20 of 128 bits; the default ``RADIUS`` of the functions finds
little beyond exact copies.  Distances scatter by about 4 bits, so nearly all copies of
similarity 0.9 (13 bits) are found and about six in ten of similarity 0.8;
unrelated texts differ in 64 bits.

Defined cases: a null text is empty; a text of fewer than three words is one
term, one without words has fingerprint zero; equal texts have equal
fingerprints; documents are ordered by descending id, a null id last, then by
a hash of the text, so ties and repeated rows have one order; a single document is its own
next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, task_count, written
from .words import gram_hashes, inside, mix, slices, span_hashes, split

TERM, BITS, HEAVIEST = 3, 128, 24
RADIUS = 3     # nearly exact copies
SIMILAR = 0.8
NEAR = math.ceil(BITS * math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi)   # 20; the cosine of sets of Jaccard J is 2J/(1+J)
TABLES = range(2, 11)
MASKS = 1 << 20    # most changes that are broadcast, 16 MB
_SIGN = np.where(np.arange(256)[:, None] >> np.arange(8)[None, :] & 1, 1.0, -1.0)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Two unsigned 64-bit lanes for every text."""
    out = np.zeros((len(column), 2), dtype=np.uint64)
    for t in slices(column):
        n = len(t.ptr) - 1
        w = split(t)
        h = span_hashes(t.buf, w.start, w.end)
        doc = w.doc()
        ok = np.flatnonzero(inside(w.ptr, TERM))
        terms = [gram_hashes(h, TERM)[ok]]
        owner = [doc[ok]]
        weight = [w.end[ok + TERM - 1] - w.start[ok]]
        for k in range(1, TERM):   # texts of fewer words are one term
            short = w.ptr[:-1][np.diff(w.ptr) == k]
            if len(short):
                terms.append(np.stack([h[short + j] for j in range(k)]).sum(axis=0, dtype=np.uint64))
                owner.append(doc[short])
                weight.append(np.ones(len(short), dtype=np.int64))
        term, doc = np.concatenate(terms), np.concatenate(owner)
        mass = np.minimum(np.concatenate(weight), HEAVIEST).astype(float)
        lanes = np.stack([mix(term), mix(term ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8).reshape(-1, 16)
        votes = np.empty((n, 16, 8))
        for j in range(16):
            seen = np.bincount(doc * 256 + lanes[:, j], mass, n * 256).reshape(n, 256)
            votes[:, j] = seen @ _SIGN
        bits = np.packbits((votes > 0).astype(np.uint8), axis=2, bitorder="little").reshape(n, 16)
        out[t.first:t.first + n] = np.ascontiguousarray(bits).view(np.uint64)
    return out


def hexed(fp: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in fp]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited(text: str, after: str) -> str:
    """``text`` whose last third is replaced by the beginning of ``after``."""
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lane0", "lane1"]
_RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double, lane0 long, lane1 long")


def _compared(ids: list, texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, after)]
    fp = fingerprints(pa.array(changed, pa.large_string()))
    return [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array(hexed(own), pa.string()), pa.array(hexed(fp), pa.string()),
            pa.array(likeness(own, fp)), pa.array(likeness(own, following)),
            pa.array(own[:, 0].copy().view(np.int64)), pa.array(own[:, 1].copy().view(np.int64))]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and that
    of the next document.  The texts are dealt once by ranges of ids; a task
    streams its range in order, and only its first and last rows meet those of
    the neighbouring ranges afterwards."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The sample that sets the ranges holds numbers only.
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text").desc()]
    dealt = own.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    names = _RESULT + ["range", "is_first", "is_last", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: tuple | None = None   # the row that waits for its next
        first = True

        def emit(ids, texts, after, own, following, is_first) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                _compared(ids, texts, after, own, following)
                + [pa.array([number] * n, pa.int32()), pa.array([is_first] + [False] * (n - 1)), pa.array([False] * n),
                   pa.array([texts[0] if is_first else None] + [None] * (n - 1), pa.string())], names=names)

        for b in batches:
            for t in slices(b.column(1)):
                n = len(t.ptr) - 1
                column = b.column(1).slice(t.first, n)
                texts = column.to_pylist()
                ids = b.column(0).slice(t.first, n).to_pylist()
                fp = fingerprints(column)
                if held:
                    ids, texts, fp = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], fp])
                if len(ids) > 1:
                    yield emit(ids[:-1], texts[:-1], texts[1:], fp[:-1], fp[1:], first)
                    first = False
                held = (ids[-1], texts[-1], fp[-1:])
        if held:   # the last row of the range; its next is in another range
            own = held[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.int64())] + [pa.nulls(1, pa.int64())] + [pa.nulls(1, pa.string())] * 3
                + [pa.nulls(1, pa.float64())] * 2 + [pa.nulls(1, pa.int64())] * 2
                + [pa.array([number], pa.int32()), pa.array([first]), pa.array([True]), pa.array([held[1]], pa.string())],
                names=names)

    rows = written(dealt.mapInArrow(run, _RESULT_DDL + ", range int, is_first boolean, is_last boolean, text string"),
                   "fingerprints")
    # One row per range: the number of the next range that holds rows, the first again after the last.
    ranges = rows.where("is_last").select("range")
    ring = ranges.select("range", F.coalesce(
        F.lead("range").over(Window.orderBy("range")),
        F.min("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .alias("following"))
    firsts = rows.where("is_first").select(F.col("range").alias("following"), F.col("text").alias("after"))
    edge = rows.where("is_last").select("doc_id", "text", "range").join(ring, "range").join(firsts, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                _compared(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                          fingerprints(b.column(1)), fingerprints(b.column(2))), names=_RESULT)

    ends = edge.select("doc_id", "text", "after").mapInArrow(finish, _RESULT_DDL)
    return rows.where("not is_last").select(*_RESULT).unionByName(ends)


def _allowances(r: int, n: int) -> list[int]:
    """Changed bits allowed in each of n blocks.  Each is one more in sum to r + 1,
    so a pair within r cannot exceed all of them (-1: the block is not used)."""
    return [(r + 1 - n) // n + (i < (r + 1 - n) % n) for i in range(n)]


def _probes(r: int, n: int) -> list[tuple[int, int]]:
    """Width of each used block and the number of changes within its allowance."""
    return [(hi - lo, sum(math.comb(hi - lo, k) for k in range(a + 1)))
            for (lo, hi), a in zip(_widths(n), _allowances(r, n)) if a >= 0]


def tables_for(rows: int, asked: int, r: int) -> int:
    """The number of tables with the least work for a query row: its probes,
    the rows that share a key with one of them (fingerprints of unrelated texts
    are spread evenly), and its part of the rows' own entries."""
    def work(n: int) -> float:
        used = _probes(r, n)
        return sum(p * (1 + rows / 2 ** w) for w, p in used) + len(used) * rows / max(asked, 1)

    fit = [n for n in TABLES if n <= max(2, r + 1) and sum(p for _, p in _probes(r, n)) <= MASKS]
    return min(fit, key=work)


def _widths(n: int) -> list[tuple[int, int]]:
    edges = [BITS * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _blocks(n: int) -> list[Column]:
    """The 128 bits in n blocks of whole bits, as numbers."""

    def bits(lane: str, lo: int, hi: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(F.col(lane), 64 - hi), 64 - hi + lo)

    out = []
    for lo, hi in _widths(n):
        if hi <= 64:
            out.append(bits("lane0", lo, hi))
        elif lo >= 64:
            out.append(bits("lane1", lo - 64, hi - 64))
        else:   # a block over both lanes
            out.append(bits("lane0", lo, 64).bitwiseOR(F.shiftleft(bits("lane1", 0, hi - 64), 64 - lo)))
    return out


def _changes(r: int, n: int) -> pa.Table:
    """``block, mask``: every change of a block's number within its allowance."""
    block, mask = [], []
    for i, ((lo, hi), a) in enumerate(zip(_widths(n), _allowances(r, n))):
        masks = [sum(1 << j for j in c) for k in range(a + 1) for c in combinations(range(hi - lo), k)]
        block += [i] * len(masks)
        mask += [m - (1 << 64) if m >> 63 else m for m in masks]
    return pa.table({"block": pa.array(block, pa.int32()), "mask": pa.array(mask, pa.int64())})


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, tables: int | None = None) -> DataFrame:
    """``lane0, lane1, near_lane0, near_lane1, near_rows``: for every distinct
    fingerprint of ``queries``, all distinct fingerprints of ``fps`` within the
    radius (itself included) and the number of rows that have them.  A pair is
    given by the first table in which it meets."""
    spark = fps.sparkSession
    n = tables or tables_for(fps.count(), queries.count(), radius)
    allowed = _allowances(radius, n)
    edges = _widths(len(allowed))
    numbers = _blocks(len(allowed))
    table = fps.groupBy("lane0", "lane1").agg(F.count(F.lit(1)).alias("near_rows"))
    table = table.select(F.col("lane0").alias("near_lane0"), F.col("lane1").alias("near_lane1"), "near_rows",
                         F.posexplode(F.array(*numbers)).alias("block", "key"))
    # A query row becomes thousands of probes: rows are dealt out before, and the probes are never broadcast.
    asked = queries.select("lane0", "lane1").repartition(task_count(spark), "lane0", "lane1").distinct()
    asked = asked.select("lane0", "lane1", F.posexplode(F.array(*numbers)).alias("block", "own"))
    masks = F.broadcast(spark.createDataFrame(_changes(radius, n)))        # at most MASKS rows
    asked = asked.join(masks, "block").select(
        "lane0", "lane1", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("key")).hint("merge")
    differing = [F.col("lane0").bitwiseXOR(F.col("near_lane0")), F.col("lane1").bitwiseXOR(F.col("near_lane1"))]

    def changed(lo: int, hi: int) -> Column:
        masks = [((1 << max(0, min(hi, k + 64) - k)) - 1) & ~((1 << max(0, lo - k)) - 1) for k in (0, 64)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        return F.bit_count(differing[0].bitwiseAND(signed[0])) + F.bit_count(differing[1].bitwiseAND(signed[1]))

    on = (asked["block"] == table["block"]) & (asked["key"] == table["key"]) & (changed(0, BITS) <= radius)
    for i, ((lo, hi), a) in enumerate(zip(edges, allowed[:-1])):   # no earlier block is within its allowance
        on = on & ((table["block"] <= i) | (changed(lo, hi) > a))
    return asked.join(table, on).select("lane0", "lane1", "near_lane0", "near_lane1", "near_rows")


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """``compare_with_next`` and, for the query rows (ids divisible by
    ``every``), the number of other rows whose fingerprint is within the radius."""
    rows = written(compare_with_next(docs), "fingerprint_rows")
    asked = rows.where(F.col("doc_id") % every == 0)
    found = within_radius(rows, asked, radius).groupBy("lane0", "lane1").agg((F.sum("near_rows") - 1).alias("n_near"))
    found = found.withColumnsRenamed({"lane0": "f0", "lane1": "f1"})
    hits = asked.join(found, (F.col("lane0") == F.col("f0")) & (F.col("lane1") == F.col("f1"))).drop("f0", "f1")
    rest = rows.where((F.col("doc_id") % every != 0) | F.col("doc_id").isNull()).withColumn("n_near", F.lit(None).cast("long"))
    return hits.unionByName(rest).drop("lane0", "lane1")
