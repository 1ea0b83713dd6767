"""Quality rules by weak supervision (operator 8).

Rules on counts of a text vote good (1), bad (-1) or abstain (0).  The votes
are counted by pattern; expectation maximisation over the pattern counts (at
most 3 to the number of rules) estimates how each rule votes on good and on bad
documents: a rule that blames much and alone is overruled, one that blames
little or agrees with others is believed.  A document is kept when the posterior probability of being good
is at least a half.  No labels are read.

Defined cases: a null text has no words; texts without words fail the base
rule; ties and repeated rows get equal verdicts, as a verdict depends on the
text's counts alone; an empty table gives an empty result and a model that
equals its prior; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .runtime import plainly_named, ship, tidy, written
from .words import gram_hashes, inside, mix, slices, span_hashes, split

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(key), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def _first_of(key: np.ndarray) -> np.ndarray:
    """Index of the first entry of each distinct value."""
    return np.unique(key, return_index=True)[1]


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    out = {c: np.zeros(len(column), dtype=np.int64) for c in COUNTS}
    for t in slices(column):
        n = len(t.ptr) - 1
        at = slice(t.first, t.first + n)
        w = split(t)
        doc = w.doc()
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        out["n_words"][at] = np.diff(w.ptr)
        lead = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
        out["word_chars"][at] = np.bincount(doc, lead[w.end] - lead[w.start], n).astype(np.int64)
        marks = np.concatenate([[0], np.cumsum(_SYMBOL[t.buf])])
        out["n_symbols"][at] = marks[t.ptr[1:]] - marks[t.ptr[:-1]]
        h = span_hashes(t.buf, w.start, w.end)
        if len(h):
            out["n_distinct_words"][at] = np.bincount(doc[_first_of(h ^ salt[doc])], minlength=n)
            g = gram_hashes(h, 5)
            ok = np.flatnonzero(inside(w.ptr, 5))
            if len(ok):
                hit = ok[_repeated(g[ok] ^ salt[doc[ok]])]
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + 5, -1)
                covered = np.cumsum(edge[:-1]) > 0
                out["n_repeat_words"][at] = np.bincount(doc[covered], minlength=n)
            # Lines that hold a word, by the whole line's bytes.
            breaks = np.flatnonzero(t.buf == 10)
            starts = np.unique(np.concatenate([t.ptr[:-1][np.diff(t.ptr) > 0], breaks + 1]))
            starts = starts[starts < len(t.buf)]
            line_doc = np.searchsorted(t.ptr, starts, side="right") - 1
            ends = np.minimum(np.append(breaks, len(t.buf))[np.searchsorted(breaks, starts)], t.ptr[line_doc + 1])
            solid = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
            starts, ends, line_doc = starts[solid], ends[solid], line_doc[solid]
            lines = np.bincount(line_doc, minlength=n)
            kept = np.bincount(line_doc[_first_of(span_hashes(t.buf, starts, ends) ^ salt[line_doc])], minlength=n)
            out["n_lines"][at] = lines
            out["n_dup_lines"][at] = lines - kept
    return out


def counted(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``keep`` and the counts, named with ``prefix``.  A text that
    is kept anyway goes to the Python workers once."""
    ship(docs.sparkSession)
    kept = source = docs.select(*[F.col(f"`{c}`") for c in keep])
    if text in keep and kept.schema[text].dataType == StringType():
        at = keep.index(text)
    else:
        at = len(keep)
        source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text__"))
    fields = ", ".join(f"`{prefix}{c}` long" for c in COUNTS)
    schema = StructType(kept.schema.fields + StructType.fromDDL(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = text_counts(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(c[x]) for x in COUNTS], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def base_failed(prefix: str = "") -> Column:
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * rep > 20 * n)


def rules(prefix: str = "") -> dict[str, Column]:
    """Vote of each rule: bad when the first condition holds, else good when
    the second does, else none."""
    c = {x: F.col(prefix + x) for x in COUNTS}
    n = c["n_words"]
    repeated, dup = 100 * c["n_repeat_words"], c["n_dup_lines"]
    # Signs of one defect depend on each other, so they are one rule.
    conditions = {
        "symbols": (10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        "repetition": ((repeated > 20 * n) | ((10 * dup > 3 * c["n_lines"]) & (repeated > 5 * n))
                       | ((n >= 50) & (20 * c["n_distinct_words"] < n)), (repeated <= 5 * n) & (dup == 0)),
        "word_length": ((c["word_chars"] < 3 * n) | (c["word_chars"] > 12 * n),
                        (c["word_chars"] >= 4 * n) & (c["word_chars"] <= 9 * n)),
        "length": (n < 10, n >= 50),
    }
    return {k: F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in conditions.items()}


def vote_pattern(prefix: str = "") -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in rules(prefix).values():
        out = out * 3 + v + 1
    return out.cast("int")


N_RULES = 4
# What is known before the votes are seen.  A poor document has one defect, which
# its own rule shows; one kind of defect is expected in about this share of all
# documents, with the weight of as many documents as there are, so the model acts
# alike at every size.  A rule that alone blames more than twice that share is
# therefore overruled, unless other rules agree with it.
_DEFECT, _SHOWN = 0.06, 0.9
# Chance of a bad vote of a rule that does not show the document's defect, on good
# (1) and poor (0) documents, held by the weight of a few documents only.
_BLAME, _BLAME_WEIGHT = {1: 0.002, 0: 0.1}, 10.0


def fit(patterns: dict[int, int], rounds: int = 5000) -> dict[int, float]:
    """Posterior probability of a good document for every vote pattern.

    The classes are the good documents and one per rule, of the documents with
    the defect that this rule shows.  How often a rule blames documents without its
    defect, how often it praises the others, and the classes' shares are estimated."""
    votes = np.array(list(product(range(3), repeat=N_RULES)))
    count = np.array([patterns.get(i, 0) for i in range(len(votes))], dtype=float)
    total = max(count.sum(), 1.0)
    seen = np.array([np.bincount(votes[:, r], count, 3) for r in range(N_RULES)])
    praise = (seen[:, 2] + 0.5) / (seen[:, 1] + seen[:, 2] + 1.0)
    share = np.array([1 - N_RULES * _DEFECT] + [_DEFECT] * N_RULES)
    blame = {k: np.full(N_RULES, p) for k, p in _BLAME.items()}
    praises = {k: praise.copy() for k in (0, 1)}
    shows = np.eye(N_RULES, dtype=bool)
    member = np.zeros((N_RULES + 1, len(votes)))
    for _ in range(rounds):
        like = np.zeros_like(member)
        for c in range(N_RULES + 1):
            k = int(c == 0)
            bad = blame[k] if k else np.where(shows[c - 1], _SHOWN, blame[k])
            chance = np.stack([bad, (1 - bad) * (1 - praises[k]), (1 - bad) * praises[k]], axis=1)
            like[c] = math.log(share[c]) + sum(np.log(chance[r][votes[:, r]]) for r in range(N_RULES))
        like = np.exp(like - like.max(axis=0))
        new = like / like.sum(axis=0)
        done, member = np.abs(new - member).max() < 1e-9, new
        if done:
            break
        mass = member * count
        for k in (1, 0):
            # Poor documents tell of a rule's blame where the rule does not show their defect.
            told = [mass[0] if k else mass[1:][~shows[r]].sum(axis=0) for r in range(N_RULES)]
            of = np.array([np.bincount(votes[:, r], told[r], 3) for r in range(N_RULES)])
            blame[k] = (of[:, 0] + _BLAME_WEIGHT * _BLAME[k]) / (of.sum(axis=1) + _BLAME_WEIGHT)
            praises[k] = (of[:, 2] + total * praise) / (of[:, 1] + of[:, 2] + total)
        share[1:] = (mass[1:].sum(axis=1) / total + _DEFECT) / 2
        share[0] = 1 - share[1:].sum()
    return {i: float(p) for i, p in enumerate(member[0])}


def learn(counts: DataFrame, prefix: str = "") -> dict[int, float]:
    """The model of a table of counts."""
    seen = counts.groupBy(vote_pattern(prefix).alias("pattern")).count().collect()   # at most 3 ** 4 rows
    return fit({r["pattern"]: r["count"] for r in seen})


def judged(counts: DataFrame, posterior: dict[int, float], prefix: str = "") -> DataFrame:
    """``counts`` with ``{prefix}base_failed``, ``{prefix}posterior`` and ``{prefix}kept``."""
    p = f"{prefix}pattern"
    voted = counts.withColumn(p, vote_pattern(prefix))
    model = counts.sparkSession.createDataFrame(list(posterior.items()), f"`{p}` int, `{prefix}posterior` double")
    failed = base_failed(prefix)
    return (voted.join(F.broadcast(model), p)                               # 81 rows
            .withColumn(f"{prefix}base_failed", failed)
            .withColumn(f"{prefix}kept", ~failed & (F.col(f"{prefix}posterior") >= 0.5)))


def score_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``posterior`` and ``kept`` of
    every document."""
    counts = written(counted(docs, ["doc_id"]), "quality_counts")
    return judged(counts, learn(counts))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with the same columns.  The
    texts are counted twice, for the model and for the verdict, and never stored
    with their counts."""
    rows, renamed = plainly_named(docs, ("text",))
    model = learn(counted(rows, []))
    return renamed(judged(counted(rows, rows.columns, prefix="__q_"), model, "__q_").where("__q_kept"))
