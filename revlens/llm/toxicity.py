"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences.  A logistic score per sentence, over hashed
byte n-grams, is combined by noisy-or into the document's score, and the
weights are trained from document labels alone; the sentence scores then say
which sentences offend.

Training reads a bounded, hash-ordered sample of labelled documents
(``sample`` rows, ``sample_bytes`` of text, single texts of up to 1/64 of that);
scoring reads every whole text.

Defined cases: a null or empty text has one empty sentence and a low score;
equal texts get equal scores; a labelled row with a null label is not trained
on; without any toxic or any clean label, every score is the share of toxic
labels (0 without labels); a class that has labelled documents but none in the
sample is an error; empty tables give empty results; other columns are
ignored (a stage passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .runtime import plainly_named, ship, tidy
from .words import _LOWER, Texts, mix, slices

GRAM = 5
BUCKETS = 1 << 20
SAMPLE, SAMPLE_BYTES = 4_000, 16 << 20
SAMPLE_SHARE = 64     # a training text has at most this part of the bytes
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


class Model(NamedTuple):
    """``weight`` of each kept n-gram (``keys`` ascending), and the bias of a sentence."""
    keys: np.ndarray
    weight: np.ndarray
    bias: float


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased bytes with their sentence, and the text of
    each sentence and its byte offset.  N-grams do not cross sentences; every text has at least
    one sentence."""
    n = len(t.buf)
    docs = len(t.ptr) - 1
    cut = np.flatnonzero(_STOP[t.buf]) + 1 if n else np.zeros(0, dtype=np.int64)
    starts = np.union1d(t.ptr[:-1], cut[cut < n])
    starts = starts[starts < n] if n else starts[:0]
    owner = np.searchsorted(t.ptr, starts, side="right") - 1
    # Empty texts get a sentence of their own without n-grams.
    empty = np.setdiff1d(np.arange(docs), owner)
    b = _LOWER[t.buf].astype(np.uint64)
    m = max(0, n - GRAM + 1)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + b[j:j + m]
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ok = sentence[:m] == sentence[GRAM - 1:] if m else np.zeros(0, dtype=bool)
    return (mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int32), sentence[:m][ok], np.append(owner, empty), starts


def _noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) per document, by logarithms."""
    return -np.expm1(np.bincount(doc, -np.logaddexp(0, z), n))


def sentence_logits(t: Texts, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit, text and byte offset of each sentence (an empty text's sentence
    comes last and has no offset)."""
    g, s, doc, starts = _grams(t)
    lookup = np.zeros(BUCKETS, dtype=np.float64)
    lookup[m.keys] = m.weight
    w = lookup[g]
    hit = w != 0
    g, s, w = g[hit], s[hit], w[hit]
    if len(g):   # an n-gram counts once in a sentence
        first = np.unique(s.astype(np.int64) * BUCKETS + g, return_index=True)[1]
        s, w = s[first], w[first]
    return m.bias + np.bincount(s, w, len(doc)), doc, starts


def scores(column: pa.Array, m: Model) -> np.ndarray:
    out = np.zeros(len(column))
    for t in slices(column):
        n = len(t.ptr) - 1
        z, doc, _ = sentence_logits(t, m)
        out[t.first:t.first + n] = _noisy_or(z, doc, n)
    return np.clip(out, 0.0, 1.0)


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 150, penalty: float = 2e-5) -> Model:
    """Keep the n-grams that are markedly more frequent in toxic documents
    and train their weights under noisy-or by gradient ascent."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        bias = np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))
        return Model(np.zeros(0, np.int32), np.zeros(0), float(bias))
    in_doc = np.zeros((2, BUCKETS))
    for t in slices(texts):
        g, s, doc, _ = _grams(t)
        seen = np.unique(doc[s].astype(np.int64) * BUCKETS + g)
        label = toxic[t.first + seen // BUCKETS].astype(int)
        for k in (0, 1):
            in_doc[k] += np.bincount((seen % BUCKETS)[label == k], minlength=BUCKETS)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((in_doc[1] + 0.5) / (n1 + 1)) - np.log((in_doc[0] + 0.5) / (n0 + 1))
    keys = np.flatnonzero((odds > np.log(4)) & (in_doc[1] >= max(3, 0.004 * n1))).astype(np.int32)
    index = np.full(BUCKETS, -1)
    index[keys] = np.arange(len(keys))
    parts = []
    docs = sentences = 0
    for t in slices(texts):
        g, s, doc, _ = _grams(t)
        g, s = index[g][index[g] >= 0], s[index[g] >= 0]
        pair = np.unique(s.astype(np.int64) * BUCKETS + g)
        parts.append((pair % BUCKETS, pair // BUCKETS + sentences, doc + docs))
        docs += len(t.ptr) - 1
        sentences += len(doc)
    f, s, doc = (np.concatenate(x) for x in zip(*parts))
    y = toxic.astype(float)
    theta = np.append(np.clip(odds[keys], 0, 4) * 0.5, -7.0)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(s, theta[:-1][f], sentences)
        p = np.clip(_noisy_or(z, doc, docs), 1e-9, 1 - 1e-9)
        # d log-likelihood / dz = sigmoid(z) * (y - p) / p
        dz = ((y - p) / p)[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(f, dz[s], len(keys)), dz.sum()) / docs
        grad[:-1] -= penalty * theta[:-1]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        theta = theta + 0.08 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)   # an n-gram is evidence or none
        theta[-1] = min(theta[-1], -4.0)
    used = theta[:-1] != 0
    return Model(keys[used], theta[:-1][used], float(theta[-1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out
    fold, and ``sample_bytes`` of their text.  A text of more than a
    ``SAMPLE_SHARE``-th of the bytes is passed over and the next in order taken, so no text ends
    the sample for those after it."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    labelled = texts.select("doc_id", "hash", F.octet_length("text").cast("long").alias("size")).join(chosen, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("hash")]
    first = (labelled.where(F.col("size") <= sample_bytes // SAMPLE_SHARE).distinct().orderBy(*order).limit(sample)
             .withColumn("bytes", F.sum("size").over(Window.orderBy(*order)))      # at most ``sample`` rows of numbers
             .where(F.col("bytes") <= sample_bytes).select("doc_id", "hash", "toxic"))
    rows = texts.join(F.broadcast(first), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).orderBy(*order)
    rows = rows.select("text", "toxic").collect()
    texts, toxic = [r["text"] for r in rows], [r["toxic"] for r in rows]
    if len(set(toxic)) < 2:
        missing = {r["toxic"] for r in labelled.select("toxic").distinct().collect()} - set(toxic)
        if missing:
            raise ValueError(f"labelled documents of class {sorted(missing)} exist, but none is in the training sample "
                             f"of {len(rows)} documents; raise sample or sample_bytes")
    return fit(pa.array(texts, pa.large_string()), np.array(toxic, dtype=np.int64))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` and the score of each row's text in the column ``name``."""
    spark = docs.sparkSession
    ship(spark)
    columns = docs.columns
    schema = StructType(docs.schema.fields + [StructField(name, DoubleType())])
    at = columns.index("text")
    shared = spark.sparkContext.broadcast(tuple(model))   # at most BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(scores(b.column(at), m))], names=columns + [name])

    return docs.mapInArrow(tidy(run), schema)


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, score``: byte offset (UTF-8) and score of each
    sentence that reaches the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            for t in slices(b.column(1)):
                z, doc, starts = sentence_logits(t, m)
                p = 1 / (1 + np.exp(-z[:len(starts)]))
                hit = np.flatnonzero(p >= threshold)
                if len(hit):
                    d = doc[hit]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(t.first + d)), pa.array(starts[hit] - t.ptr[d]), pa.array(p[hit])],
                        names=["doc_id", "start", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, start long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = with_score(own, train(own, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with the same columns."""
    rows, renamed = plainly_named(docs, ("doc_id", "text"))
    return renamed(with_score(rows, train(rows, labels), "__toxicity__").where(F.col("__toxicity__") < threshold))
