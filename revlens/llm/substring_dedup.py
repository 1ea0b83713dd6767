"""Removal of repeated passages by FM-indexes (operator 6).

A window is ``window`` consecutive words of a document.  A word goes if a
window over it also starts earlier: in a document of smaller id, or earlier in
the same one.  All windows are judged on the input.

1. Every window is routed by its minimiser, the least hash of its runs of
   ``GRAM`` words, so equal windows go the same way.  Successive windows with
   one minimiser are a passage; passages whose minimiser occurs once in the
   corpus have no equal and stay behind.
2. Passages are put together by content; of equal ones all but the first are
   repeats as a whole.
3. The different passages are dealt to shards by minimiser.  Each shard gets an
   FM-index, through which its passages are streamed: backward search over the
   wavelet matrix gives every window's interval, and the earliest start in the
   interval says whether the window is a repeat.
4. The repeated runs return to their documents.

A minimiser with over ``HOT`` passages is dealt window by window instead, by
the window's own hash, so the edges of a very common passage spread out.

Defined cases: a null text has no words; texts under ``window`` words stay
whole; rows that repeat (id and text) count as one document, of texts that
share an id the one with the smaller hash comes first, and a null id comes
before all others; an empty table gives an empty result; other columns are
ignored (the stage passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .runtime import plainly_named, ship, tidy, written
from .words import gram_hashes, slices, span_hashes, split

WINDOW, GRAM = 20, 8
HOT = 50_000
SHARD_WORDS = 400_000


def passages_of(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each passage, for the
    word hashes of whole texts."""
    g = gram_hashes(h, GRAM)
    m = len(h) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = g[:m].copy(), np.zeros(m, dtype=np.int64)
    for j in range(1, window - GRAM + 1):
        less = g[j:j + m] < best
        best = np.where(less, g[j:j + m], best)
        at[less] = j
    at += np.arange(m)
    whole = doc[:m] == doc[window - 1:]
    begins = np.append(True, at[1:] != at[:-1]) | np.append(True, doc[1:m] != doc[:m - 1])
    begins |= np.append(False, ~whole[:-1])
    start = np.flatnonzero(begins & whole)
    label = np.cumsum(begins) - 1
    size = np.bincount(label[whole], minlength=label[-1] + 1)
    return start, size[label[start]], best[start]


def _named(docs: DataFrame) -> DataFrame:
    """``did, tid, text``: an id without nulls and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"),
                       F.xxhash64(text).alias("tid"), text.alias("text"))


def _routed(named: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(2)):
                w = split(t)
                doc = w.doc()
                start, count, key = passages_of(span_hashes(t.buf, w.start, w.end), doc, window)
                row = pa.array(t.first + doc[start])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), b.column(0).take(row), b.column(1).take(row),
                     pa.array((start - w.ptr[doc[start]]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["key", "did", "tid", "start", "n"])

    return named.mapInArrow(tidy(run), "key long, did long, tid long, start int, n int")


def _cut(joined: DataFrame, window: int) -> DataFrame:
    """Passages with their words, from ``did, tid, text, parts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "did", "tid", "start", "n", "words"]
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0
            parts = b.column(3)
            for t in slices(b.column(2)):
                w = split(t)
                h = span_hashes(t.buf, w.start, w.end)
                buf = t.buf.tobytes()
                for i in range(len(t.ptr) - 1):
                    row = t.first + i
                    did, tid = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                    p = parts[row].values
                    lo, hi = w.ptr[i], w.ptr[i + 1]
                    word = [buf[a:z] for a, z in zip(w.start[lo:hi], w.end[lo:hi])]
                    begin, count, key, hot = (p.field(k).to_pylist() for k in range(4))
                    for s, n, k, x in zip(begin, count, key, hot):
                        if x:   # window by window
                            own = gram_hashes(h[lo + s:lo + s + n + window - 1], window).view(np.int64)
                            pieces = [(int(own[j]), s + j, 1) for j in range(n)]
                        else:
                            pieces = [(k, s, n)]
                        for v in pieces:
                            text = b" ".join(word[v[1]:v[1] + v[2] + window - 1])
                            size += len(text)
                            for c, y in zip(out, (v[0], did, tid, v[1], v[2], text)):
                                c.append(y)
                    if size > 4 << 20:
                        yield _batch(out, names)
                        out, size = ([], [], [], [], [], []), 0
            if out[0]:
                yield _batch(out, names)

    return joined.mapInArrow(tidy(run), "key long, did long, tid long, start int, n int, words string")


def _batch(out: tuple[list, ...], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(out, kinds)]
    return pa.RecordBatch.from_arrays(columns[:5] + [columns[5].cast(pa.string())], names=names)


def shard_repeats(did: np.ndarray, tid: np.ndarray, start: np.ndarray, n: np.ndarray, words: list[str],
                  window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows at the first place of each different passage:
    passage, first window, end."""
    ids: dict[str, int] = {}
    text = []
    for p in words:
        text += [ids.setdefault(x, len(ids) + 1) for x in p.split(" ")]
        text.append(0)
    symbols = np.array(text, dtype=np.int64)
    begin = np.concatenate([[0], np.flatnonzero(symbols == 0)[:-1] + 1])
    fm = FMIndex(symbols, len(ids) + 1, window)
    lo, hi = fm.windows(symbols, begin, n.astype(np.int64))
    if (hi <= lo).any():
        raise AssertionError("a passage is missing from its own index")
    # Every window's place in the order of (id, hash of the text, start).
    passage = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((start[passage] + at, tid[passage], did[passage]))
    rank = np.empty(len(passage), dtype=np.int64)
    rank[order] = np.arange(len(passage))
    value = np.full(len(symbols), len(passage), dtype=np.int64)
    value[begin[passage] + at] = rank
    earliest = fm.least(value, lo)
    # The same window of one document can be in two passages of a shard.
    same = (did[passage][order[earliest]] == did[passage]) & (tid[passage][order[earliest]] == tid[passage]) & \
        ((start[passage] + at)[order[earliest]] == start[passage] + at)
    repeat = ~same
    edge = np.flatnonzero(repeat & np.append(True, ~repeat[:-1] | (passage[1:] != passage[:-1])))
    stop = np.flatnonzero(repeat & np.append(~repeat[1:] | (passage[1:] != passage[:-1]), True))
    return passage[edge], at[edge], at[stop] + 1


def repeated_runs(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``did, tid, lo, hi``: windows ``lo`` to ``hi - 1`` of a document are repeats."""
    ship(docs.sparkSession)
    named = _named(docs)
    routed = written(_routed(named, window), "routed")
    shared = written(routed.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "shared_keys")
    part = F.struct("start", "n", "key", (F.col("total") > hot).alias("hot"))
    per_doc = routed.join(shared, "key").groupBy("did", "tid").agg(F.collect_set(part).alias("parts"))
    joined = named.join(per_doc, ["did", "tid"]).select("did", "tid", "text", "parts")
    passages = _cut(joined, window).withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64("words", F.lit(1)))
    passages = written(passages, "passages")
    first = F.min(F.struct("did", "tid", "start"))
    different = written(passages.groupBy("key", "h1", "h2", "n").agg(first.alias("f"), F.first("words").alias("words"))
                        .select("key", "h1", "h2", "n", "f.did", "f.tid", "f.start", "words"), "different")
    total = different.agg(F.sum(F.col("n") + (window - 1))).first()[0] or 0
    shards = int(max(1, -(-total // shard_words)))

    def index(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in ("did", "tid", "start", "n")}
        p, a, z = shard_repeats(col["did"], col["tid"], col["start"].astype(np.int64), col["n"].astype(np.int64),
                                t.column("words").to_pylist(), window)
        s = col["start"][p]
        return pa.table({"did": col["did"][p], "tid": col["tid"][p], "lo": (s + a).astype(np.int32),
                         "hi": (s + z).astype(np.int32)})

    at_first = (different.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "did", "tid", "start", "n", "words")
                .groupBy("shard").applyInArrow(index, "did long, tid long, lo int, hi int"))
    firsts = different.select("key", "h1", "h2", F.col("did").alias("fd"), F.col("tid").alias("ft"), F.col("start").alias("fs"))
    later = passages.select("key", "h1", "h2", "did", "tid", "start", "n").join(firsts, ["key", "h1", "h2"])
    later = later.where((F.col("did") != F.col("fd")) | (F.col("tid") != F.col("ft")) | (F.col("start") != F.col("fs")))
    later = later.select("did", "tid", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    return written(at_first.union(later), "repeated_runs")


def without_repeats(docs: DataFrame, window: int = WINDOW, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (``doc_id`` if not given) and ``__n_words``,
    ``__n_removed``, ``__kept``: the words that stay, joined by one space."""
    spark = docs.sparkSession
    keep = columns or ["doc_id"]
    runs = repeated_runs(docs, window).groupBy("did", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("__runs"))
    runs = runs.select(F.col("did").alias("__did"), F.col("tid").alias("__tid"), "__runs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"),
                      F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__d"), F.xxhash64(text).alias("__t"))
    own = own.join(runs, (F.col("__d") == F.col("__did")) & (F.col("__t") == F.col("__tid")), "left")
    own = own.select(*[F.col(f"`{c}`") for c in keep], "__text", "__runs")
    schema = StructType(own.drop("__text", "__runs").schema.fields
                        + StructType.fromDDL("__n_words long, __n_removed long, __kept string").fields)
    names = [f.name for f in schema]
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for b in batches:
            runs_of = b.column(k + 1)
            for t in slices(b.column(k)):
                w = split(t)
                docs_here = len(t.ptr) - 1
                edge = np.zeros(len(w.start) + 1, dtype=np.int64)
                for i in range(docs_here):
                    r = runs_of[t.first + i]
                    if r.is_valid:
                        lo = r.values.field(0).to_numpy() + w.ptr[i]
                        hi = r.values.field(1).to_numpy() + w.ptr[i]
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi + window - 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                buf = t.buf.tobytes()
                kept = []
                for i in range(docs_here):
                    word = slice(w.ptr[i], w.ptr[i + 1])
                    s = stay[word]
                    kept.append(b" ".join([buf[a:z] for a, z in zip(w.start[word][s].tolist(), w.end[word][s].tolist())]))
                before = np.concatenate([[0], np.cumsum(~stay)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(j).slice(t.first, docs_here) for j in range(k)]
                    + [pa.array(np.diff(w.ptr)), pa.array(before[w.ptr[1:]] - before[w.ptr[:-1]]),
                       pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return own.mapInArrow(tidy(run), schema)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
                      F.sha2(F.encode("__kept", "UTF-8"), 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns, repeated passages gone from the text;
    untouched texts stay as they are, and ``n_chars``, if there is one, follows."""
    rows, renamed = plainly_named(docs, ("doc_id", "text", "n_chars"))
    columns = rows.columns
    out = without_repeats(rows, window, columns)
    touched = F.col("__n_removed") > 0
    new = {"text": F.when(touched, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(touched, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return renamed(out.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns]))
