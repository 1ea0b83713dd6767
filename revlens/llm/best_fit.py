"""Hierarchical best-fit packing (operator 13).

Texts become byte-level BPE ids plus an end id.  A text of at most ``capacity``
ids is one piece; a longer one is cut into pieces of ``capacity``, of which the
first may be shorter.

1. Each partition of the texts packs its pieces by itself: block by block, the
   longest first, each goes to the open bin with the least room that takes it.
2. Nearly full bins are done.  The others become items of the size they have
   reached, and a tree of merges, ``FAN_IN`` nodes to one, packs these items by
   the same rule, round by round, until one node is left.

Best fit leaves a node at most one bin that is at most half full, so a merge of
``FAN_IN`` nodes can move at most ``FAN_IN`` items into others, and no more than
``FAN_IN`` hosts of one fill are of use to each of the rounds ahead.  A node
passes on that many of each fill; the rest is done.  A task of a merge thus
holds a bounded number of items at any size of the corpus, and nothing is lost
by it.

Defined cases: a null or empty text is its end id alone; rows that repeat (id
and text) are packed one by one; a text that holds a special token's string
gets that token's id, as the tokenizer gives it; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import CACHE_BYTES, default_tokenizer, tokenizer
from .runtime import ship, tidy, written

CAPACITY = 2048
END_ID = 0
FAN_IN = 8
# A bin with less room than this is done.
NEARLY_FULL = 2
BLOCK = 20_000
_SLICE = 1 << 20
_BIN = 1 << 33              # bins of a node are numbered from node * _BIN

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("node", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())])
_MERGED = pa.schema([("node", pa.int64()), ("bin", pa.int64()), ("host", pa.int64()), ("shift", pa.int64()),
                     ("fill", pa.int64())])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a text of ``n`` ids."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


class Bins:
    """Open bins by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0                       # bit r: a bin has room r

    def put(self, bin_: int, room: int) -> None:
        if room > 0:
            self.by_room[room].append(bin_)
            self.rooms |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room that ``length`` fits in, and its room."""
        fits = self.rooms >> length
        if not fits:
            return None
        room = length + (fits & -fits).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        return bin_, room

    def add(self, length: int, own: int) -> tuple[int, int]:
        """Bin and offset of an item; a bin that it opens is named ``own``."""
        found = self.take(length)
        bin_, room = found if found else (own, self.capacity)
        self.put(bin_, room - length)
        return bin_, self.capacity - room


def local_bins(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
               cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """The pieces of all texts with ``node`` (their partition), ``bin`` and
    ``offset`` in it."""
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, int]]:
        ids, texts, size = [], [], 0

        def cut() -> Iterator[tuple[int, int, int, int, int]]:
            for doc_id, raw in zip(ids, tokenizer(path, cache_bytes).ids(texts)):
                raw += end
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    yield doc_id, k, s, n, zlib.crc32(memoryview(raw)[4 * s:4 * (s + n)])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > _SLICE:
                    yield from cut()
                    ids, texts, size = [], [], 0
        yield from cut()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        bins, opened = Bins(capacity), 0
        block: list[tuple[int, int, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal opened
            places: list[tuple[int, int]] = [(0, 0)] * len(block)
            for i in sorted(range(len(block)), key=lambda i: -block[i][3]):
                place = bins.add(block[i][3], node * _BIN + opened)
                opened += place[1] == 0
                places[i] = place
            columns = list(zip(*block)) + [[node] * len(block)] + list(zip(*places))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

        for piece in tokens(batches):
            block.append(piece)
            if len(block) >= BLOCK:
                yield packed()
                block = []
        if block:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run, keep_chunks=True), "doc_id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long")


def useful(bins: DataFrame, rounds: int, capacity: int) -> DataFrame:
    """The bins ``node, bin, fill`` that the rounds ahead can use."""
    same = Window.partitionBy("node", "fill").orderBy("bin")
    return (bins.where(F.col("fill") <= capacity - NEARLY_FULL).withColumn("rank", F.row_number().over(same))
            .where(F.col("rank") <= FAN_IN * rounds).drop("rank"))


def merge(bins: DataFrame, capacity: int) -> DataFrame:
    """One round: the bins of ``FAN_IN`` nodes as items, packed by best fit.
    ``node, bin, host, shift, fill``: an item that stays is its own host, and
    ``fill`` is then what it has become."""
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        items = sorted(zip(table.column("bin").to_pylist(), table.column("fill").to_pylist()), key=lambda x: (-x[1], x[0]))
        open_, fill, out = Bins(capacity), {}, []
        for bin_, size in items:
            host, shift = open_.add(size, bin_)
            fill[host] = shift + size
            out.append((bin_, host, shift))
        columns = [[node] * len(out), *zip(*out), [fill[bin_] if bin_ == host else 0 for bin_, host, _ in out]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MERGED)], schema=_MERGED)

    up = bins.select(F.expr(f"node div {FAN_IN}").alias("node"), "bin", "fill")
    return up.groupBy("node").applyInArrow(run, "node long, bin long, host long, shift long, fill long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Every piece of every text with its place: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``."""
    pieces = written(local_bins(docs, path or default_tokenizer(), capacity, cache_bytes=cache_bytes), "best_fit_pieces")
    fills = pieces.groupBy("node", "bin").agg(F.sum("length").alias("fill"))
    nodes = (pieces.agg(F.max("node")).first()[0] or 0) + 1
    rounds = 0
    while FAN_IN ** rounds < nodes:
        rounds += 1
    moved = None
    for done in range(rounds):
        merged = written(merge(useful(fills, rounds - done, capacity), capacity), f"best_fit_round{done}")
        moves = merged.where(F.col("bin") != F.col("host")).select("bin", "host", "shift")
        if moved is None:
            moved = moves
        else:       # a host of an earlier round that moved itself
            again = moves.select(F.col("bin").alias("host"), F.col("host").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(again, "host", "left").select(
                "bin", F.coalesce("next", "host").alias("host"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).unionByName(moves)
        fills = merged.where(F.col("bin") == F.col("host")).select("node", "bin", "fill")
    if moved is None:
        out = pieces.withColumn("sequence_id", F.col("bin"))
    else:
        out = pieces.join(moved, "bin", "left").withColumn("sequence_id", F.coalesce("host", "bin")).withColumn(
            "offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
