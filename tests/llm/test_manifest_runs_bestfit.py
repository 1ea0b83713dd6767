"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import best_fit, byte_bpe, merkle, periodic_runs, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars int, node string, `a.b` string, tree string, runs string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t), "x", "y", "z", "r") for i, t in texts]


def corner_texts():
    rnd = random.Random(4)
    few = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) for _ in range(60)]
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 300), (5, "a b c\n" * 40 + "a b d " * 5), (5, "a b c\n" * 40),
            (None, "x y " * 9), (6, "one"), (7, "Zähne 1  中文 " * 12), (8, "<|endoftext|> x"),
            (9, " ".join(f"w{i % 700}" for i in range(6000)))] + [(20 + i, t) for i, t in enumerate(few)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(corner_texts()), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_runs(w, least):
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p):
                stretch = w[i:i + length]
                if not any(all(stretch[k] == stretch[k + q] for k in range(length - q)) for q in range(1, p)):
                    out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_equal_brute_force(docs, least):
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"])
                              for r in periodic_runs.find_runs(docs, least).collect())
    want = collections.Counter()
    for i, t in corner_texts():
        w = SPLIT.findall(t or "")
        runs = brute_runs(w, least) if len(w) < 1000 else [(0, 6000, 700)]
        want[i, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert got == want


def test_random_words_against_brute_force():
    rnd, rng = random.Random(7), np.random.default_rng(7)
    value = rng.integers(1, 1 << 63, 8, dtype=np.uint64)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, kinds = rnd.choice([0, 1, 12, 40, 90]), rnd.choice([1, 2, 3, 8])
            w = [rnd.randrange(kinds) for _ in range(n)]
            texts.append(w + w if rnd.random() < .3 else w)
        ptr = np.cumsum([0] + [len(w) for w in texts])
        found = zip(*(x.tolist() for x in periodic_runs.runs_of(
            np.array([value[x] for w in texts for x in w], dtype=np.uint64), ptr, 4)))
        want = [(int(o) + s, n, p) for w, o in zip(texts, ptr) for s, n, p in brute_runs(w, 4)]
        assert list(found) == want


def test_periodic_runs_query(spark, tmp_path):
    texts = [(i, t) for i, t in corner_texts() if i is not None] + [(i, " ".join(str(k) for k in range(i % 70))) for i in range(100, 300)]
    spark.createDataFrame(rows_of(texts), DOCS).drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())
    want, planted = collections.Counter(), 0
    for i, t in texts:
        w = SPLIT.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute_runs(w, 12) if n < 1000 else [(0, 6000, 700)]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want[(i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
              hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())] += 1
    assert planted > 10 and got == want


def test_runs_of_an_empty_table(empty):
    assert periodic_runs.find_runs(empty).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_tree(digests, arity):
    """Root and, per leaf, the (left, right) siblings of each level."""
    level, at = list(digests), list(range(len(digests)))
    paths = [[] for _ in digests]
    while len(level) > 1:
        for leaf, k in enumerate(at):
            lo = k // arity * arity
            paths[leaf].append(("".join(level[lo:k]), "".join(level[k + 1:lo + arity])))
        level = [sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], paths


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_rows():
    texts = corner_texts()
    out = [(i, t, "en" if k % 3 else None, ["a", "b", None, "Z", "é", ""][min(k % 11, 5)], k % 4 or None, "n", "d", "t", "r")
           for k, (i, t) in enumerate(texts)]
    return out + [(70, "alone\nhere", "en", "lone", 3, "n", "d", "t", "r")] + [out[4]] * 3


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_equals_a_plain_tree(spark, arity):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, DOCS)
    leaf = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    got = merkle.build(df, F.col("source"), F.col("doc_id"), leaf, carry={"tree": F.col("text")}, arity=arity)
    seen = merkle.check(F.col("leaf"), F.col("path"), F.col("root"))
    got = got.select("key", F.lower(F.hex("leaf")), F.lower(F.hex("subroot")), F.lower(F.hex("root")),
                     seen.proof, "tree", seen.verified).collect()
    groups = {}
    for i, t, lang, source, n, *_ in rows:
        digest = sha("".join(map(field, (i, source, lang, n, t))))
        groups.setdefault(source, []).append((i is not None, i or 0, digest, i, t))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: naive_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], arity) for s in names}
    root, above = naive_tree([trees[s][0] for s in names], arity)
    want = collections.Counter()
    for s, up in zip(names, above):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            want[x[3], x[2], trees[s][0], root, "".join(a + b for a, b in path + up), x[4], True] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_manifest_of_one_row_one_group_and_none(spark, empty):
    leaf = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    assert merkle.build(empty, F.col("source"), F.col("doc_id"), leaf).count() == 0
    for n in (1, 2, 9, 10):
        df = spark.createDataFrame(rows_of([(i, "t") for i in range(n)]), DOCS)
        got = merkle.build(df, F.col("source"), F.col("doc_id"), leaf)
        got = got.select("key", F.lower(F.hex("root")).alias("root"), merkle.check(F.col("leaf"), F.col("path"), F.col("root"))[2]).collect()
        root, _ = naive_tree([sha("".join(map(field, (i, "s", "en", 1, "t")))) for i in range(n)], 3)
        assert sorted(map(tuple, got)) == [(i, root, True) for i in range(n)]


def test_manifest_query_finds_every_tampered_text(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_merkle_manifest(spark, sf).collect():
        broken = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] == (not broken) == (r["folded_root"] == r["root"])


def encode(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(byte_bpe.default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cuts_leave_the_short_piece_first():
    assert best_fit.cuts(5, 8) == [(0, 5)]
    assert best_fit.cuts(16, 8) == [(0, 8), (8, 8)]
    assert best_fit.cuts(19, 8) == [(0, 3), (3, 8), (11, 8)]


@pytest.mark.parametrize("partitions", [1, 3, 30])
def test_best_fit_packs_every_id_once(spark, docs, partitions):
    """30 partitions take two rounds of merges."""
    got = best_fit.pack_documents(docs.repartition(partitions), capacity=256).collect()
    want = collections.Counter()
    total = 0
    for (i, _), ids in zip(corner_texts(), encode([t or "" for _, t in corner_texts()])):
        ids = np.array(ids + [0], dtype="<u4")
        total += len(ids)
        for k, (s, n) in enumerate(best_fit.cuts(len(ids), 256)):
            want[i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    sums = sorted(sum(n for _, n in b) for b in bins.values())
    assert len(bins) <= -(-total // 256) + 2 and sums[0] + sums[1] > 256 - best_fit.NEARLY_FULL


def test_best_fit_of_items_over_half(spark):
    """No two fit together: every text is alone, whatever the number of rounds."""
    df = spark.createDataFrame(rows_of([(i, "word " * 40) for i in range(200)]), DOCS).repartition(20)
    got = best_fit.pack_documents(df, capacity=64).collect()
    assert len({r["sequence_id"] for r in got}) == 200 and {r["offset"] for r in got} == {0}


def test_useful_hosts_lose_no_fit(spark):
    """Merging only the useful hosts gives as few bins as merging all of them."""
    rnd = random.Random(3)
    fills = []
    for node in range(64):
        fills += [(node, (node << 33) + k, rnd.choice([60, 70, 80, 90])) for k in range(200)]
        fills.append((node, (node << 33) + 999, rnd.choice([10, 20, 30])))
    df = spark.createDataFrame(fills, "node long, bin long, fill long")
    left = df
    moved = 0
    for rounds in (2, 1):
        merged = best_fit.merge(best_fit.useful(left, rounds, 100), 100).cache()
        moved += merged.where("bin <> host").count()
        left = merged.where("bin = host").select("node", "bin", "fill")
    open_ = best_fit.Bins(100)
    opened = sum(open_.add(f, b)[1] == 0 for _, b, f in sorted(fills, key=lambda x: (-x[2], x[1])))
    assert len(fills) - moved == opened


def test_best_fit_of_an_empty_table(empty):
    assert best_fit.pack_documents(empty).count() == 0


def test_chunks_looked_up_equal_the_tokenizer():
    """Also when the table of chunks changes generations at every call."""
    texts = [t or "" for _, t in corner_texts()]
    small = byte_bpe.ChunkTokenizer(byte_bpe.default_tokenizer(), cache_bytes=2000)
    for _ in range(3):
        for i in range(0, len(texts), 7):
            got = [np.frombuffer(x, dtype="<u4").tolist() for x in small.ids(texts[i:i + 7])]
            assert got == encode(texts[i:i + 7])
    assert small.size < 100_000


def test_a_chunk_takes_one_lookup():
    """New chunks are met in the lookup itself, and words among them skip the tokenizer's pipeline."""
    t = byte_bpe.ChunkTokenizer(byte_bpe.default_tokenizer())
    texts = ["one unheardofword, unheardofword and don't can't É1 x1", "two unheardofword.\nNext\u00e9 a I", "A b\tc d's e"]
    seen = []
    parts = t._encode_parts
    t._encode_parts = lambda some: seen.extend(some) or parts(some)
    want = [np.array(ids, dtype="<u4").tobytes() for ids in encode(texts)]
    assert t.ids(texts) == want
    assert "unheardofword," in seen and not any(p.isascii() and p.isalpha() for p in seen)
    assert t.known["unheardofword"] == t._encode_parts(["unheardofword"])[0] and not t.known.new
    older = t.known
    t.known = byte_bpe._Chunks(older)
    seen.clear()
    assert t.ids(texts) == want and not seen and t.size > 0
    t.forget()
    assert t.size == 0 and t.ids(texts) == want
