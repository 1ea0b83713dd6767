"""Packing by minimum bin slack (operator 2).

Texts become byte-level BPE ids plus an end id and are cut into pieces of at
most ``capacity`` ids.  Pieces are packed by length: the lengths that remain
are a histogram of at most ``capacity`` cells, so the driver's part is bounded
however many documents there are.  For each kind of sequence, the longest
remaining piece is set and a bitset subset-sum over the remaining counts finds
the multiset that fills the rest closest to capacity, by backtracking; that
pattern is used as often as its counts allow.  Spark then ranks the pieces of
each length and looks up sequence and offset in the patterns.

Defined cases: a null or empty text is its end id alone; rows that repeat (id
and text) are packed one by one; a text that holds a special token's string
gets that token's id, as the tokenizer gives it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import CACHE_BYTES, ChunkTokenizer, default_tokenizer, tokenizer  # noqa: F401
from .runtime import ship, task_count, tidy, written

CAPACITY = 2048
END_ID = 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False,
           cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of the
    pieces of every text.  A worker keeps ``cache_bytes`` of looked-up chunks."""
    ship(docs.sparkSession)
    fields = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, ids in zip(doc_ids, tokenizer(path, cache_bytes).ids(texts)):
            ids += end
            n = len(ids) // 4
            for s in range(0, n, capacity):
                part = ids[4 * s:4 * (s + capacity)]
                for c, v in zip(out, (doc_id, s, len(part) // 4, zlib.crc32(part), n)):
                    c.append(v)
                if with_ids:
                    out[5].append(np.frombuffer(part, dtype="<i4"))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 2 << 20:
                    yield cut(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield cut(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, keep_chunks=True), fields)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the counted lengths whose sum is closest to, and not
    over, ``capacity``: a bitset of reachable sums grows length by length
    (each count in binary parts), and the counts are read by backtracking."""
    if capacity <= 0:
        return {}
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] > 0 and x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= take * length
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: count) with how often each is used; together they use
    the whole histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = closest_fill(left, capacity - seed)
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces_table`` (stored) with ``sequence_id`` and ``offset``."""
    spark = pieces_table.sparkSession
    salts = max(32, task_count(spark))
    salted = pieces_table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # Ranks within (length, salt), then moved by the cells before: a length
    # that very many pieces share is not ordered in one task.
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"])
              .withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt"))

    # Per length: for each pattern that uses it, the first rank, the count per
    # sequence, the first sequence, and the offset in the sequence.
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    first_sequence = 0
    used: dict[int, int] = {}
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            c = pattern[length]
            uses.setdefault(length, []).append((used.get(length, 0), c, first_sequence, offset))
            used[length] = used.get(length, 0) + c * times
            offset += c * length
        first_sequence += times
    tables = {k: np.array(v, dtype=np.int64) for k, v in uses.items()}
    shared = spark.sparkContext.broadcast(tables)   # patterns of few lengths; about capacity times a logarithm of the largest count
    names = ranked.columns
    at_length, at_rank = names.index("length"), names.index("rank")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(at_length).to_numpy()
            rank = b.column(at_rank).to_numpy()
            seq = np.zeros(len(rank), dtype=np.int64)
            off = np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(length):
                m = length == k
                t = shared.value[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[m], side="right") - 1]
                r = rank[m] - row[:, 0]
                seq[m] = row[:, 2] + r // row[:, 1]
                off[m] = row[:, 3] + (r % row[:, 1]) * k
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(b.columns) if i != at_rank] + [pa.array(seq), pa.array(off)],
                names=[n for n in names if n != "rank"] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(tidy(run), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``."""
    stored = written(pieces(docs, path or default_tokenizer(), capacity, cache_bytes=cache_bytes), "pieces")
    return pack(stored, capacity).withColumn("length", F.col("length").cast("long"))
