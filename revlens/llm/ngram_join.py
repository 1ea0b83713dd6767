"""N-gram Jaccard join by grouped prefixes (operator 1).

A document's set is its distinct word shingles; two documents link when
``den * intersection >= num * union``.  Shingles are ordered from rare to
frequent, and linked sets share a shingle of their prefixes.

1. Equal sets are one class, and classes with equal prefixes and size one
   group; only groups enter the lists of documents that share a prefix shingle.
2. Pairs of groups in a list are filtered by size and position, and those of
   their members by parity bitmaps (the bitmaps of two sets differ in at most
   as many bits as the sets in shingles).  First every list links its members
   to one pivot; the verified links join classes to components.
3. Lists that still hold several components are expanded to the members of
   their groups, and every pair of members of different components that passes
   the filters is verified.  Pairs within a component cannot change it, so no
   link between components is lost and a large group of near copies is not
   expanded into all its pairs.

The order of shingles may be any, and a good one only makes lists short.  It
goes by the counts of their words and then by those of frequent shingles, all
taken over all texts; both tables have a fixed size.  Sets are compared by 64-bit shingle hashes.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; fewer words than a shingle's are one shingle; an id that repeats
is one document with several texts; rows with a null id are told apart by text
alone, and link through copies with an id only; an empty table gives an empty
result; other columns are ignored (the stage passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import plainly_named, ship, tidy, written
from .words import Texts, gram_hashes, inside, mix, set_digests, slices, span_hashes, split

COUNTED = 1 << 17      # words, and shingles, whose counts order the shingles
BITMAP = 1024
_CHUNK = 4_000_000     # shingles that a task counts at a time
_RARE = 96             # levels from here on are those of frequent shingles


class Rule(NamedTuple):
    """Shingles of ``words`` words; similarity of at least ``num / den``."""
    words: int = 3
    num: int = 90
    den: int = 100


class Order(NamedTuple):
    """Hashes (ascending) and levels of frequent words and of frequent shingles."""
    word: np.ndarray
    word_level: np.ndarray
    shingle: np.ndarray
    shingle_level: np.ndarray


def _levels(keys: np.ndarray, level: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(h):
        return np.zeros(len(h), dtype=np.uint8)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, level[at], 0).astype(np.uint8)


def shingles(t: Texts, words: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and level of every shingle (not yet distinct), and the
    hashes of the words."""
    w = split(t)
    h = span_hashes(t.buf, w.start, w.end, lower=True)
    doc = w.doc()
    ok = np.flatnonzero(inside(w.ptr, words))
    out, owner = [gram_hashes(h, words)[ok]], [doc[ok]]
    count = np.diff(w.ptr)
    short = []
    for k in range(1, words):
        at = w.ptr[:-1][count == k]
        if len(at):
            out.append(mix(gram_hashes_at(h, at, k) + np.uint64(k)))
            owner.append(doc[at])
            short.append(len(at))
    g = np.concatenate(out)
    level = np.zeros(len(g), dtype=np.uint8)
    if order is not None:
        of_word = _levels(order.word, order.word_level, h)
        for j in range(words):      # at most 31 per word, 3 words count
            if j < 3:
                level[:len(ok)] += of_word[ok + j]
        of_run = _levels(order.shingle, order.shingle_level, g)
        level = np.where(of_run > 0, _RARE + of_run, level).astype(np.uint8)
    return g, np.concatenate(owner), level, h


def gram_hashes_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = h[at].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[at + j]
    return out


def _by_doc(doc: np.ndarray) -> np.ndarray:
    """Stable order by a small number."""
    small = doc.astype(np.uint16) if len(doc) == 0 or doc.max() < 65536 else doc
    return np.argsort(small, kind="stable")


def distinct_shingles(t: Texts, words: int, order: Order | None = None
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending, with their text and level;
    the size of every set and where it ends."""
    h, doc, level, _ = shingles(t, words, order)
    o = np.argsort(h)
    o = o[_by_doc(doc[o])]
    h, doc, level = h[o], doc[o], level[o]
    fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[:len(h)]
    h, doc, level = h[fresh], doc[fresh], level[fresh]
    n = np.bincount(doc, minlength=len(t.ptr) - 1)
    return h, doc, level, n, np.cumsum(n)


def often(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``h`` holds three times or more, ascending, and how
    often.  ``h`` is sorted in its own place; what else is needed takes a few
    bits for each entry."""
    h.sort()
    if len(h) < 3:
        return h[:0], np.zeros(0, dtype=np.int64)
    first = h[2:] == h[:-2]
    first[1:] &= h[1:-2] != h[:-3]
    at = np.flatnonzero(first)
    return h[at], np.searchsorted(h, h[at], side="right") - at


def counted_order(texts: DataFrame, rule: Rule) -> Order:
    """The ``COUNTED`` most frequent words and shingles and the logarithms of
    their counts.  A task counts in chunks; what a chunk holds once or twice is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, _CHUNK), dtype=np.uint64)
        size = [0, 0]

        def counted(kind: int) -> pa.RecordBatch:
            h, n = often(held[kind, :size[kind]])
            size[kind] = 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, dtype=np.int32)),
                                               pa.array(h.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

        for b in batches:
            for t in slices(b.column(0)):
                g, _, _, h = shingles(t, rule.words)
                for kind, x in ((0, h), (1, g)):
                    while len(x):       # a long text can fill several chunks
                        part = x[:_CHUNK - size[kind]]
                        held[kind, size[kind]:size[kind] + len(part)] = part
                        size[kind] += len(part)
                        x = x[len(part):]
                        if size[kind] == _CHUNK:
                            yield counted(kind)
        for kind in (0, 1):
            if size[kind]:
                yield counted(kind)

    sums = written(texts.select("text").mapInArrow(tidy(run), "kind int, h long, n long")
                   .groupBy("kind", "h").agg(F.sum("n").alias("n")), "counts")
    out = []
    for kind in (0, 1):     # two tables of fixed size
        t = sums.where(F.col("kind") == kind).orderBy(F.desc("n"), "h").limit(COUNTED).select("h", "n").toArrow()
        h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
        o = np.argsort(h)
        out += [h[o], np.minimum(np.log2(n[o] + 1.0), 31).astype(np.uint8)]
    return Order(*out)


def _parity(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A bitmap per text: bit ``b`` is the parity of the shingles that hash to it."""
    out = np.zeros((docs, BITMAP // 64), dtype=np.uint64)
    for lo in range(0, docs, 1000):
        hi = min(docs, lo + 1000)
        a, z = np.searchsorted(doc, (lo, hi))
        cell = (doc[a:z] - lo) * BITMAP + (mix(h[a:z]) >> np.uint64(32)).astype(np.int64) % BITMAP
        odd = (np.bincount(cell, minlength=(hi - lo) * BITMAP) & 1).astype(np.uint8).reshape(hi - lo, BITMAP)
        out[lo:hi] = np.packbits(odd, axis=1).view(np.uint64)
    return out


def with_sets(texts: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """``doc_id, n, cid, gid, prefix, bits``: size and digest of each set, its
    prefix and the group of that prefix and size, and the parity bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Order(*shared.value)
        for b in batches:
            for t in slices(b.column(1)):
                docs = len(t.ptr) - 1
                h, doc, level, n, ends = distinct_shingles(t, rule.words, known)
                cid = set_digests(h, ends, n)
                bits = _parity(h, doc, docs)
                o = np.argsort(level, kind="stable")
                h = h[o[_by_doc(doc[o])]]
                length = np.where(n > 0, n - -(-rule.num * n // rule.den) + 1, 0)
                place = np.concatenate([[0], np.cumsum(length)])
                spot = np.arange(place[-1]) - np.repeat(place[:-1], length)
                prefix = h[spot + np.repeat(ends - n, length)]
                gid = set_digests(prefix + mix(spot.astype(np.uint64)), place[1:], length) ^ mix(n.astype(np.uint64))
                width = BITMAP // 64
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.first, docs), pa.array(n), pa.array(cid.view(np.int64)),
                     pa.array(gid.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(prefix.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * width, pa.int32()),
                                              pa.array(bits.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n", "cid", "gid", "prefix", "bits"])

    return texts.mapInArrow(tidy(run), "doc_id long, n long, cid long, gid long, prefix array<long>, bits array<long>")


def whole_sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """``cid, shingles`` of rows ``cid, text`` whose set has that digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column(1)):
                docs = len(t.ptr) - 1
                wanted = b.column(0).slice(t.first, docs).to_numpy()
                h, _, _, n, ends = distinct_shingles(t, rule.words)
                cid = set_digests(h, ends, n).view(np.int64)
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(h.view(np.int64)))
                right = pa.array(cid == wanted)
                yield pa.RecordBatch.from_arrays([pa.array(wanted).filter(right), sets.filter(right)], names=["cid", "shingles"])

    return texts.mapInArrow(tidy(run), "cid long, shingles array<long>")


def _need(rule: Rule, n1: Column, n2: Column) -> Column:
    """The least overlap of two linked sets of these sizes."""
    return F.ceil(F.lit(rule.num) * (n1 + n2) / F.lit(rule.den + rule.num))


def _may_link(rule: Rule, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Size and position filter: with the first common shingle at these places,
    the overlap can still reach what the sizes ask for."""
    return (rule.den * F.least(n1, n2) >= rule.num * F.greatest(n1, n2)) & \
        (F.least(n1 - p1, n2 - p2) >= _need(rule, n1, n2))


def near_enough(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bitmaps allow a link."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("left"))
    other = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("right"))
    apart = F.aggregate(F.zip_with("left", "right", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    na, nb = F.col("na"), F.col("nb")
    return (pairs.join(one, "a").join(other, "b")
            .where((rule.den * F.least(na, nb) >= rule.num * F.greatest(na, nb)) & (apart <= na + nb - 2 * _need(rule, na, nb)))
            .select("a", "b"))


def sets_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The whole sets of the classes in ``pairs``."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    wanted = wanted.join(classes.select("cid", F.col("rep").alias("doc_id")), "cid")
    return written(whole_sets(texts.join(wanted, "doc_id").select("cid", "text"), rule).dropDuplicates(["cid"]), "whole_sets")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` of classes that link."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (pairs.join(right, "b").join(left, "a")
            .where(rule.den * both >= rule.num * (F.size("left") + F.size("right") - both)).select("a", "b"))


def join_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the size of each document's set
    and the least id reachable by links."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(with_sets(texts, rule, counted_order(texts, rule)), "sets")
    full = rows.where("n > 0")
    classes = written(full.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("gid").alias("gid"),
                                              F.min("n").alias("n"), F.first("bits").alias("bits")), "classes")

    # Lists of groups that share a prefix shingle, each row with the list's pivot:
    # the group that has it nearest to the front, so with the fewest rarer ones.
    groups = full.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows_of = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    by_token = Window.partitionBy("token").orderBy("pos", "gid")
    so_far = by_token.rowsBetween(Window.unboundedPreceding, 0)
    lists = rows_of.select(
        "token", "gid", "n", "pos", F.first("gid").over(so_far).alias("pivot"), F.first("n").over(so_far).alias("pivot_n"),
        F.first("pos").over(so_far).alias("pivot_pos"),
        (F.lag("gid").over(by_token).isNotNull() | F.lead("gid").over(by_token).isNotNull()).alias("shared"))
    lists = written(lists.where("shared").drop("shared"), "lists")

    leads = classes.groupBy("gid").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("members"))
    star = (lists.where(F.col("gid") != F.col("pivot"))
            .where(_may_link(rule, F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos")))
            .select("pivot", "gid").distinct())
    one = leads.select("gid", F.col("cid").alias("b"))
    other = leads.select(F.col("gid").alias("pivot"), F.col("cid").alias("a"))
    grown = leads.where("members > 1").select("gid", F.col("cid").alias("lead"))
    inner = classes.join(grown, "gid").where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    first = star.join(one, "gid").join(other, "pivot").select("a", "b").union(inner)
    first = written(near_enough(first, classes, rule), "star_pairs")

    # Every class of a list, with the group itself as one more list.
    member = classes.select("gid", "cid")
    spread = lists.select("token", "gid", "n", "pos").join(member, "gid").select("token", "cid", "n", "pos")
    own = classes.join(grown.select("gid"), "gid").select(F.col("gid").alias("token"), "cid", "n", F.lit(0).alias("pos"))
    spread = written(spread.union(own), "members")

    links = written(verified(first, sets_of(first, classes, texts, rule), rule), "links")
    labels = components(links)
    # What is left: lists with several components.
    held = spread.join(labels.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("label", F.coalesce("label", "cid"))
    open_lists = held.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    held = written(held.join(open_lists, "token"), "open_members")
    l, r = held.alias("l"), held.alias("r")
    rest = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.cid") < F.col("r.cid"))
                  & (F.col("l.label") != F.col("r.label"))
                  & _may_link(rule, F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos")))
    rest = rest.select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct()
    rest = written(near_enough(rest, classes, rule), "rest_pairs")
    links = written(links.union(verified(rest, sets_of(rest, classes, texts, rule), rule)), "links")
    labels = components(links)

    least = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    least = least.join(least.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select(
        F.col("node").alias("cid"), "component_id")
    known = classes.select("cid", "rep").join(least, "cid", "left").select(
        "cid", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
    return out.join(known, "cid", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group, with the same
    columns; of rows equal in id and text one stays.  Different texts under one
    id stay or go together, as groups are known by id; a row without an id has
    none, so of those only copies of the text go."""
    rows, renamed = plainly_named(docs, ("doc_id", "text"))
    kept = join_documents(rows, rule).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = written(kept, "kept")
    stay = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*rows.columns)
    stay = stay.unionByName(rows.where("doc_id is null")).withColumn("__text", F.xxhash64("text"))
    return renamed(stay.dropDuplicates(["doc_id", "__text"]))
