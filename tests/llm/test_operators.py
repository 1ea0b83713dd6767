"""Each operator against brute force, an exact round trip or its rules, with
nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from revlens.llm import (chat, fingerprints, ngram_join, packing, quality, queries, sentencepiece_sampling, sharding,
                         runtime, substring_dedup, toxicity, warc)
from revlens.llm.fm_index import FMIndex
from revlens.llm.runtime import new_path
from revlens.llm.words import gram_hashes, mix, span_hashes

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def corner_texts() -> list[tuple[int | None, str | None]]:
    base, passage = prose(1, 200), prose(99, 40)
    return [(1, base), (2, base), (3, base + " more"), (4, base.replace("alpha", "ALPHA")), (5, None), (6, ""),
            (7, " \n\t "), (8, "one"), (9, "one two"), (10, "one two"), (11, prose(2, 60) + " " + passage + " " + prose(3, 60)),
            (12, prose(4, 30) + "\n" + passage), (13, "a " * 300), (14, prose(5, 5000)), (None, prose(6, 40)),
            (None, prose(6, 40)), (15, prose(7, 50)), (15, prose(7, 50)), (16, "of%%% the### " * 40), (17, "x" * 3000)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in corner_texts()], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _words(t):
    return SPLIT.findall(t or "")


def _shingles(t, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _words(t)]
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _components(sets, num, den):
    """Least id of the component of each set."""
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 80, 100)])
def test_ngram_join_equals_all_pairs(docs, rule):
    rows = [r for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    sets = {r.doc_id: _shingles(r.text, rule.words) for r in rows}
    want = _components(sets, rule.num, rule.den)
    got = [r for r in ngram_join.join_documents(docs, rule).collect()]
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_ngram_join_keeps_one_and_takes_empty_tables(docs, empty):
    kept = ngram_join.keep_one(docs, ngram_join.Rule())
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 1 in ids and not {2, 3, 10} & set(ids) and ids.count(15) == 1 and {5, 6, 7} <= set(ids)
    assert ngram_join.join_documents(empty).count() == 0


def _without_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = _words(t)
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                stay[k:k + window] = [False] * window
            seen.add(x)
        out[i] = (len(w), stay.count(False), " ".join(x for x, s in zip(w, stay) if s))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_equal_brute_force(docs, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "repeated_runs",
                        lambda d, w, f=substring_dedup.repeated_runs: f(d, w, hot=hot, shard_words=300))
    want = _without_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = substring_dedup.without_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["__n_words"], r["__n_removed"], r["__kept"]) == want[r.doc_id], r.doc_id


def test_repeats_stage_keeps_columns(docs, empty):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_fm_index_finds_streamed_windows():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    fm = FMIndex(text, 5, 6)
    stream = np.concatenate([text[20:60], rng.integers(-1, 5, 80)])
    lo, hi = fm.windows(stream, np.array([0]), np.array([len(stream) - 5]))
    for i in range(len(stream) - 5):
        want = sum(np.array_equal(text[j:j + 6], stream[i:i + 6]) for j in range(len(text) - 5))
        assert hi[i] - lo[i] == want
        if want:
            assert sorted(fm.order[lo[i]:hi[i]]) == [j for j in range(len(text) - 5) if np.array_equal(text[j:j + 6], stream[i:i + 6])]


def test_closest_fill_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = {int(k): int(c) for k, c in zip(rng.integers(3, 40, 5), rng.integers(1, 4, 5))}
        best = {0}
        for k, c in counts.items():
            best = {b + k * i for b in best for i in range(c + 1) if b + k * i <= 61}
        got = packing.closest_fill(counts, 61)
        assert sum(k * c for k, c in got.items()) == max(best)
        assert all(c <= counts[k] for k, c in got.items())


def test_packing_holds_every_id_once(docs, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, capacity=256).collect()
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
           for r in docs.collect()}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in docs.collect())
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty).count() == 0


def test_tokenizer_chunks_equal_whole_texts():
    t = packing.ChunkTokenizer(packing.default_tokenizer())
    texts = ["", "a  b", " x", "a\tb c", " ", "<|endoftext|> q", "it's\nok. No", "x y z", "a\n b", "tail "]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert t.ids(texts) == want


def test_sampled_segmentations(docs, empty, spark):
    a = sentencepiece_sampling.encode_documents(docs.select("doc_id", "text"))
    b = sentencepiece_sampling.encode_documents(docs.repartition(7).select("doc_id", "text"))
    rows = a.collect()
    key = lambda r: repr((r.doc_id, r.ids_crc32, r.n_pieces))
    assert sorted(map(key, rows)) == sorted(map(key, b.collect())) and all(r.lossless for r in rows)
    back = sentencepiece_sampling.decode_documents(a).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    other = sentencepiece_sampling.encode_documents(docs, seed=1).collect()
    assert {r.ids_crc32 for r in rows} != {r.ids_crc32 for r in other}
    assert sentencepiece_sampling.encode_documents(empty).count() == 0


def test_sampling_follows_the_weights():
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model(), 1.0)
    word = "the"
    paths = collections.Counter()
    w = dict(zip(lat.id.tolist(), lat.weight.tolist()))
    n = 4000
    ids, first = sentencepiece_sampling.sample([word] * n, np.arange(n), lat, 3)
    for a, b in zip(first[:-1], first[1:]):
        paths[tuple(ids[a:b].tolist())] += 1
    weight = {p: float(np.prod([w[i] for i in p])) for p in paths}
    p, q = paths.most_common(2)[0][0], paths.most_common(2)[1][0]
    assert sentencepiece_sampling.decode(np.array(p), np.array([0, len(p)]), lat) == [word]
    share = weight[p] / (weight[p] + weight[q])
    seen = paths[p] / (paths[p] + paths[q])
    assert abs(share - seen) < 0.05


def _share_of_each(lat, text):
    """Every segmentation of a text (with a space before it) and its probability, by recursion over all pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sampling.default_model())
    weight = dict(zip(lat.id.tolist(), lat.weight.tolist()))
    pieces = {sp.id_to_piece(i).replace("\u2581", " "): i for i in weight}

    def paths(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if (i := pieces.get(rest[:k])) is not None:
                for p, w in paths(rest[k:]):
                    yield (i, *p), weight[i] * w
        if rest and rest[0] not in pieces:
            for p, w in paths(rest[1:]):
                yield (*lat.byte[list(rest[0].encode())].tolist(), *p), lat.least * w

    all_paths = dict(paths(" " + text))
    return {p: w / sum(all_paths.values()) for p, w in all_paths.items()}


@pytest.mark.parametrize("text", ["a_{b", "__x_", "if:\n    y", "a;\r\n)\r", "\u4e2d\u56fd\u4eba", "a    b"])
@pytest.mark.parametrize("longest", [64, 1])
def test_sampling_is_over_the_whole_lattice(text, longest, monkeypatch):
    monkeypatch.setattr(sentencepiece_sampling, "LONGEST", longest)
    monkeypatch.setattr(sentencepiece_sampling, "_BLOCK", 4096 if longest > 1 else 2)
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model(), 1.0)
    want = _share_of_each(lat, text)
    n = 6000
    ids, first = sentencepiece_sampling.sample([text] * n, np.arange(n), lat, 5)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:]))
    assert set(seen) <= set(want)
    for p, w in want.items():
        assert abs(seen[p] / n - w) < 5 * (w * (1 - w) / n) ** 0.5 + 1e-3


def test_no_piece_is_out_of_reach_and_long_runs_are_whole():
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model(), 1.0)
    for i in lat.id.tolist():
        name = lat.bytes[lat.starts[i]:lat.starts[i] + lat.sizes[i]].tobytes().decode()
        assert any(name in w for w in lat.words("\n" + name + "\n")), name
    run = "=" * 20_000
    ids, first = sentencepiece_sampling.sample([run, "x"], np.arange(2), lat, 0)
    assert sentencepiece_sampling.decode(ids, first, lat) == [run, "x"]
    place = np.cumsum(lat.sizes[ids[:first[1]]]) - 1
    assert not set(range(64, 20_000, 64)) <= set(place.tolist())     # pieces cross the former cuts


def test_literal_marks_and_odd_characters_survive():
    lat = sentencepiece_sampling.lattice(sentencepiece_sampling.default_model(), 1.0)
    texts = ["a▁b  c", "日本 \U0001F600\n x", "<s> <0x41> </s>", " lead", "x" * 500, ""]
    ids, first = sentencepiece_sampling.sample(texts, np.arange(len(texts)), lat, 0)
    out = sentencepiece_sampling.decode(ids, first, lat)
    assert out == texts


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint_documents(docs, every=2).collect()
    by = {r.doc_id: r for r in rows}
    ordered = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id != 15}, reverse=True)
    for (i, t), (j, u) in zip(ordered, ordered[1:]):
        if i - 1 == j:
            t, u = t or "", u or ""
            k = len(t) // 3
            changed = t[:len(t) - k] + u[:k]
            assert by[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and by[i].n_chars == len(t)
    assert by[1].fingerprint == by[2].fingerprint and by[9].fingerprint == by[10].fingerprint
    prints = [int(r.fingerprint, 16) for r in rows]
    for r in rows:
        if r.n_near is not None:
            assert r.n_near == sum(bin(int(r.fingerprint, 16) ^ p).count("1") <= 3 for p in prints) - 1
    assert len(rows) == docs.count() and fingerprints.fingerprint_documents(empty).count() == 0


def test_near_copies_count_each_other(spark, monkeypatch):
    def edits(seed, n):   # n words replaced, spread over the text
        w = prose(seed, 200).split()
        for k in range(n):
            w[(k * 37 + 11) % 200] = f"new{k}"
        return " ".join(w)

    texts = [edits(seed, n) for seed in (21, 22, 23) for n in (0, 1, 2, 3)] + [prose(s, 200) for s in range(31, 36)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_shingles(t, 3) for t in texts]
    # The registered query with its own radius, over these texts and with every row as a query row.
    monkeypatch.setattr(queries, "table", lambda *_: df)
    monkeypatch.setattr(fingerprints, "fingerprint_documents",
                        lambda d, f=fingerprints.fingerprint_documents, **k: f(d, every=1, **k))
    for r in queries.queries()["op4_fingerprints"](spark, "").collect():
        near = [j for j, s in enumerate(sets) if j != r.doc_id and len(s & sets[r.doc_id]) >= 0.9 * len(s | sets[r.doc_id])]
        far = [j for j, s in enumerate(sets) if len(s & sets[r.doc_id]) < 0.5 * len(s | sets[r.doc_id])]
        assert len(near) <= r.n_near < len(texts) - len(far) and (r.doc_id >= 12 or near)


def test_fingerprints_equal_plain_votes(spark):
    def plain(text):
        w = [x.encode() for x in _words(text)]
        runs = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else []
        hash1 = lambda x: int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
        votes = [0] * 128
        for run in runs:
            term = gram_hashes(np.array([hash1(x) for x in run], dtype=np.uint64), 3)[:1]
            bits = int(mix(term)[0]) | int(mix(term ^ np.uint64(0x5851F42D4C957F2D))[0]) << 64
            weight = min(24, len(b" ".join(run)))
            for i in range(128):
                votes[i] += weight if bits >> i & 1 else -weight
        return sum(1 << i for i in range(128) if votes[i] > 0)

    texts = [prose(s, n) for s, n in ((1, 3), (2, 20), (3, 90), (4, 250))] + ["", "\u00e4\u00f6 \u6f22\u5b57 x y z"]
    number = lambda h: int(h[:16], 16) | int(h[16:], 16) << 64
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 128
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints.compare_with_next(df).collect():
        own, after = texts[r.doc_id], texts[r.doc_id - 1]
        k = len(own) // 3
        changed = own[:len(own) - k] + after[:k]
        assert number(r.fingerprint) == plain(own) and number(r.edited_fingerprint) == plain(changed)
        assert r.near_edited == like(plain(own), plain(changed)) and r.near_next == like(plain(own), plain(after))


def test_share_of_similar_texts_within_the_radius():
    """Of texts of Jaccard 0.9 at least nine in ten lie within NEAR; at 0.8 about half do."""
    def found(changed_words):
        a, b, rng = [], [], np.random.default_rng(3)
        for seed in range(120):
            w = [f"w{x}" for x in rng.integers(0, 10 ** 6, 600)]
            a.append(" ".join(w))
            for k in rng.choice(np.arange(0, 600, 4), changed_words, replace=False):
                w[k] = f"n{rng.integers(0, 10 ** 6)}"
            b.append(" ".join(w))
        fa, fb = (fingerprints.fingerprints(pa.array(x)) for x in (a, b))
        return (np.bitwise_count(fa ^ fb).sum(axis=1) <= fingerprints.NEAR).mean()

    assert found(10) >= 0.9 and 0.35 <= found(22) <= 0.75     # 3 shingles a word: 0.905 and 0.80


def test_tables_follow_the_number_of_rows():
    r = fingerprints.NEAR
    candidates = {}
    for rows in (10 ** 5, 10 ** 6, 10 ** 7, 10 ** 8, 10 ** 9):
        n = fingerprints.tables_for(rows, rows // 50, r)
        used = fingerprints._probes(r, n)
        assert fingerprints._changes(r, n).num_rows == sum(p for _, p in used) <= fingerprints.MASKS
        candidates[rows] = sum(p * rows / 2 ** w for w, p in used)
    assert candidates[10 ** 9] < 500 * candidates[10 ** 5]      # 10,000 times the rows


@pytest.mark.parametrize("radius,tables", [(0, None), (1, None), (3, None), (9, None), (20, None), (20, 5), (20, 10)])
def test_block_tables_miss_no_pair(spark, radius, tables):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (12, 1, 128), dtype=np.uint8)
    flips = np.zeros((12, radius + 3, 128), dtype=np.uint8)
    for g in range(12):
        for k in range(radius + 3):
            flips[g, k, rng.choice(128, k, replace=False)] = 1
    lanes = np.packbits((base ^ flips).reshape(-1, 128), axis=1).view(np.int64)
    df = spark.createDataFrame([tuple(map(int, x)) for x in lanes], "lane0 long, lane1 long")
    got = [tuple(r) for r in fingerprints.within_radius(df, df, radius, tables).collect()]
    rows = collections.Counter(tuple(map(int, x)) for x in lanes)
    distance = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    assert sorted(got) == sorted(a + b + (n,) for a in rows for b, n in rows.items() if distance(a, b) <= radius)


def test_toxicity_learns_from_document_labels(spark, empty):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = pa.array(["clean words only here.", "clean words. You idiot moron clown, worthless scum.", "", None])
    score = toxicity.scores(texts, model)
    assert score[1] > score[0] and score[2] == score[3] and score.max() <= 1
    rows = toxicity.score_documents(docs, labels)
    assert rows.count() == docs.count()
    crc = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r.held_out == crc(r.doc_id) for r in rows.collect())
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_a_long_text_does_not_end_the_training_sample(spark):
    from pyspark.sql import functions as F
    bad, good = "they called him a stupid fool. ", "the weather is mild today. "
    rows = [(i, (good + bad if i % 3 == 0 else good) * 3, int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    first = df.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first().doc_id
    long = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit(good), 1000)).otherwise(F.col("text")))
    model = toxicity.train(long, df.select("doc_id", "toxic"), sample_bytes=20_000)
    score = toxicity.scores(pa.array([good + bad, good]), model)
    assert score[0] > 0.7 > score[1]
    with pytest.raises(ValueError):
        toxicity.train(df, df.select("doc_id", "toxic"), sample_bytes=64)


def test_noisy_or_finds_the_sentence():
    bad, good = "they called him a stupid fool.", "the weather is mild today."
    texts = pa.array([f"{good} {bad} {good}" if i % 3 == 0 else f"{good} {good}" for i in range(60)])
    model = toxicity.fit(texts, np.array([int(i % 3 == 0) for i in range(60)]))
    z, doc, starts = toxicity.sentence_logits(next(toxicity.slices(texts[:1])), model)
    assert int(np.argmax(z)) == 1 and toxicity.scores(texts, model)[0] > 0.7 > toxicity.scores(texts, model)[1]


def test_quality_counts_equal_brute_force(docs, empty):
    for r in quality.score_quality(docs).collect():
        t = next(x.text for x in docs.where("doc_id is null" if r.doc_id is None else f"doc_id = {r.doc_id}").collect()) or ""
        w = _words(t)
        lines = [x for x in t.split("\n") if _words(x)]
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeated = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.score_quality(empty).count() == 0


def test_quality_model_separates_defects():
    fine, junk, repeats = 80, 26, 74     # patterns in base 3: (1,1,1,1), (-1,1,1,1), (1,-1,1,1)
    p = quality.fit({fine: 1000, junk: 60, repeats - 12: 60})
    assert p[fine] > 0.8 and p[junk] < 0.5


def _pattern(*votes):
    return int("".join(str(v + 1) for v in votes), 3)


def test_a_lone_rule_is_overruled_when_it_blames_much():
    fine, lone = _pattern(1, 1, 1, 1), _pattern(-1, 1, 1, 1)
    p = [quality.fit({fine: round(1e5 * (1 - s)), lone: round(1e5 * s)})[lone] for s in (0.01, 0.05, 0.1, 0.2, 0.3, 0.5)]
    assert p == sorted(p) and p[1] < 0.1 and p[4] > 0.5 and p[5] > 0.5
    # The model does not depend on the number of documents.
    assert abs(quality.fit({fine: 700, lone: 300})[lone] - p[4]) < 0.05


def test_agreeing_rules_are_believed_beside_a_noisy_one():
    rng = np.random.default_rng(0)
    votes = np.full((50_000, 4), 1)
    votes[rng.random(len(votes)) < 0.3, 0] = -1
    poor = rng.random(len(votes)) < 0.05
    votes[poor, 1] = -1
    votes[poor & (rng.random(len(votes)) < 0.6), 2] = -1
    p = quality.fit(collections.Counter(_pattern(*v) for v in votes.tolist()))
    assert p[_pattern(-1, 1, 1, 1)] > 0.9
    assert max(p[_pattern(1, -1, -1, 1)], p[_pattern(1, -1, 1, 1)], p[_pattern(-1, -1, -1, 1)]) < 0.1


def test_posterior_equals_a_plain_model(spark):
    """One step of expectation and maximisation by plain loops leaves the fitted posterior as it is."""
    seen = {_pattern(1, 1, 1, 1): 800, _pattern(-1, 1, 1, 1): 40, _pattern(1, -1, 1, 1): 50, _pattern(1, -1, 0, 1): 9,
            _pattern(1, 1, 1, 0): 60, _pattern(-1, 0, 1, 1): 7}
    p, n, R = quality.fit(seen), sum(seen.values()), range(4)
    votes = {k: [int(d) for d in np.base_repr(k, 3).zfill(4)] for k in seen}

    def total(weight, r, v):
        return sum(w * weight[k] for k, w in seen.items() if votes[k][r] == v)

    def praise(weight, r):
        one = {k: 1.0 for k in seen}
        base = (total(one, r, 2) + 0.5) / (total(one, r, 1) + total(one, r, 2) + 1)
        return (total(weight, r, 2) + n * base) / (total(weight, r, 1) + total(weight, r, 2) + n)

    # Poor documents are split among the defects until that does not change either.
    member = [{k: p[k] for k in seen}] + [{k: (1 - p[k]) / 4 for k in seen} for _ in R]
    for _ in range(3000):
        share = [0.0] + [(sum(seen[k] * m[k] for k in seen) / n + 0.06) / 2 for m in member[1:]]
        share[0] = 1 - sum(share)
        chance = []
        for c in range(5):
            row = []
            for r in R:
                told = member[0] if c == 0 else {k: sum(member[d + 1][k] for d in R if d != r) for k in seen}
                all_of = sum(total(told, r, v) for v in range(3))
                bad = (total(told, r, 0) + 10 * (0.002 if c == 0 else 0.1)) / (all_of + 10)
                bad = 0.9 if c == r + 1 else bad
                good = praise(told, r)
                row.append((bad, (1 - bad) * (1 - good), (1 - bad) * good))
            chance.append(row)
        new = [{} for _ in range(5)]
        for k in seen:
            like = [share[c] * np.prod([chance[c][r][votes[k][r]] for r in R]) for c in range(5)]
            for c in range(5):
                new[c][k] = like[c] / sum(like)
        member = new
    assert all(abs(member[0][k] - p[k]) < 1e-4 for k in seen)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] \\ <|im_end|>\n<|turn|>"), (1, 1, "user", None), (1, 2, "assistant", "a\\<|b"),
            (1, 2, "assistant", "a\\<|b"), (1, None, None, "first"), (None, 1, "assistant", ""), (2, 1, "as\nsist", "\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(out.formatted).alias("t"),
                                            chat.loss_text(out.formatted, out.loss_spans).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [("", "first"), ("user", rows[0][3]), ("user", ""),
                                                    ("assistant", "a\\<|b"), ("assistant", "a\\<|b")]
    assert got[1].loss == "a\\<|b" * 2 and got[None].loss == "" and [tuple(x) for x in got[2].t] == [("as\nsist", "\n")]
    assert got[1].formatted.count("<|im_start|>") == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nx", None), (4, "http://d", ""), (5, "u", "é" * 5000),
            (2, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to)
           for r in warc.round_trip(df, new_path(spark, "warc")).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4),
         (4, 0, "response", None), (5, 10000, "response", None)], key=repr)
    assert warc.round_trip(df.limit(0), new_path(spark, "warc")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    one = [warc.record(i, "http://x", f"page {i} " * 40, "D", None) for i in range(6)]
    parts = [warc._member(r) for r in one] if packed else one
    data = bytearray(b"".join(parts))
    start = sum(map(len, parts[:2]))
    data[start + 40:start + 60] = b"\x00" * 20
    if not packed:   # a false length
        data[start:start + len(parts[2])] = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)[:len(parts[2])]
    got = list(warc.salvage(bytes(data)))
    found = [r.headers["warc-record-id"] for r in got if r.headers]
    assert [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)] == found
    gaps = [(r.offset, r.size) for r in got if r.headers is None]
    assert gaps == [(start, len(parts[2]))]
    assert [r.headers for r in warc.salvage(b"rubbish")] == [None]


@pytest.mark.parametrize("damage", ["record", "crc", "end", "block"])
@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_one_member(damage, level):
    import gzip
    rng = np.random.default_rng(4)
    parts = [warc.record(i, "http://x", rng.bytes(3000).hex(), "D", None) for i in range(40)]
    if damage == "record":
        parts[2] = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    data = gzip.compress(b"".join(parts), level)
    cut = len(data) // 2
    if damage == "crc":
        data = data[:-8] + b"\x00" * 8
    elif damage == "end":
        data = data[:cut]
    elif damage == "block":
        data = data[:cut] + b"\xff" * 400 + data[cut + 400:]
    got = list(warc.salvage(data))
    ids = [int(re.search(r"page:(\d+)", r.headers["warc-record-id"])[1]) for r in got if r.headers]
    assert any(r.headers is None for r in got) and len(ids) == len(set(ids))
    if damage == "record":
        assert ids == [i for i in range(40) if i != 2] and [r.size for r in got if r.headers is None] == [len(parts[2])]
    elif damage == "crc":
        assert ids == list(range(40))
    else:
        assert ids[:18] == list(range(18))


def test_sharding(docs, empty, spark):
    rows = sharding.shard(docs, new_path(spark, "map"), shards=3, slots=64).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(sorted(p) == list(range(len(p))) for p in places.values())
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                               for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert len({r.version for r in rows}) == 1 and all(r.shard in range(3) for r in rows)
    assert sharding.shard(empty, new_path(spark, "map")).count() == 0


def test_shards_hold_equal_bytes_by_an_edited_map(spark):
    sizes = collections.Counter()
    path = new_path(spark, "map")
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows = sharding.shard(docs, path, shards=24).select("vslot", "shard", "size", "version").collect()
    dealt = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
        dealt[r.vslot % 24] += r.size
    mean = sum(sizes.values()) / 24
    assert {r.version for r in rows} == {2} and len(rows) == docs.count()
    assert max(sizes.values()) < 1.005 * mean and min(sizes.values()) > 0.995 * mean < max(dealt.values()) / 1.05
    # The next run edits the newest map: the same rows move nothing, two shards more take slots.
    again = sharding.shard(docs, path, shards=24).select("version").first()
    assert again.version == 2
    grown = sharding.shard(docs, path, shards=26).select("shard", "size", "version").collect()
    bytes_of = collections.Counter()
    for r in grown:
        bytes_of[r.shard] += r.size
    assert {r.version for r in grown} == {3} and max(bytes_of.values()) < 1.005 * sum(bytes_of.values()) / 26


def test_slot_map_versions_and_rebalancing(spark):
    weights = {v: (100 + v % 7, 1) for v in range(512)}
    first = sharding.rebalanced_map(sharding.dealt_map(4, 512), weights, 4)
    grown = sharding.rebalanced_map(first, weights, 5)
    load = collections.Counter()
    for v, s in enumerate(grown):
        load[s] += weights[v][0]
    assert max(load.values()) <= 1.03 * sum(load.values()) / 5
    assert all(b == 4 for a, b in zip(first, grown) if a != b)
    path = new_path(spark, "map")
    sharding.store_map(spark, path, 1, first)
    sharding.store_map(spark, path, 2, grown)
    stored = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert [stored[v] for v in range(512)] == grown and sharding.load_map(spark, path, 1).count() == 512


def test_queries_equal_their_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF_SMALL).toPandas().astype(object)
        want = con.execute(sql).df().astype(object)
        cols = sorted(want.columns)
        bag = lambda d: sorted(repr([None if pd.isna(v) else str(v).removesuffix(".0") for v in r]) for r in d[cols].values)
        assert sorted(got.columns) == cols and bag(got) == bag(want), name


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_SMALL)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF_SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids and 0 < len(ids) < docs.count()


def test_further_columns_of_any_name_pass_the_stages(spark):
    rows = [(i, t, "x", 1, "y", 2.0, "z", "v", "q") for i, t in corner_texts()]
    names = ["doc_id", "text", "__runs", "__text", "__toxicity__", "__q_n_words", "a.b", "other_2", "tick`s"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(
        names, "long string string int string double string string string".split())))
    labels = spark.createDataFrame([(1, 1), (9, 0), (14, 0)], "doc_id long, toxic int")
    import corpus_pipeline
    stages = [lambda d: toxicity.keep_clean(d, labels), quality.keep_good, substring_dedup.remove_repeats,
              lambda d: ngram_join.keep_one(d, corpus_pipeline.NEAR_DUPLICATES)]
    for stage in stages:
        out = stage(docs)
        assert out.schema.names == names and all(r["a.b"] == "z" and r["__runs"] == "x" for r in out.collect())
        assert stage(docs.limit(0)).count() == 0


def test_near_duplicates_under_one_id_are_both_kept(spark):
    import corpus_pipeline
    one, two = prose(61, 80), prose(62, 80)
    docs = spark.createDataFrame([(1, one), (1, two), (1, one), (2, one), (None, two), (None, two), (None, one)],
                                 "doc_id long, text string")
    kept = ngram_join.keep_one(docs, corpus_pipeline.NEAR_DUPLICATES).collect()
    assert sorted((r.doc_id or 0, r.text == one) for r in kept) == [(0, False), (0, True), (1, False), (1, True)]


@pytest.mark.parametrize("alpha", [0.5, 3.0, 8.0])
def test_sampling_is_lossless_at_any_sharpness(spark, alpha):
    texts = [t for _, t in corner_texts()] + ["qzxj" * 15, "\u0416" * 60, "aeiou" * 12 + "\U0001F600" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sentencepiece_sampling.encode_documents(df, alpha=alpha).collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)


def test_offending_sentences_and_plain_noisy_or(spark):
    bad, good = "they called him a stupid fool.", "the weather is mild today."
    df = spark.createDataFrame([(i, f"{good} {bad} {good}" if i % 3 == 0 else f"{good} {good}", int(i % 3 == 0))
                                for i in range(90)], "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    found = toxicity.offending(df, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(90) if i % 3 == 0} and len(found) == 30
    for r in found:
        text = f"{good} {bad} {good}".encode()
        assert text[r.start:].lstrip().startswith(bad.encode())
    texts = pa.array([f"{good} {bad} {good}", good, f"{bad} {bad}"], pa.large_string())
    z, doc, _ = toxicity.sentence_logits(next(toxicity.slices(texts)), model)
    for i, score in enumerate(toxicity.scores(texts, model)):
        clean = 1.0
        for x in z[doc == i]:
            clean *= 1 - 1 / (1 + np.exp(-x))
        assert abs(score - (1 - clean)) < 1e-9


def test_work_arrays_do_not_grow_with_a_batch():
    """Counting and scoring 4 MB of text takes less than 64 MB beside the text."""
    import tracemalloc
    column = pa.array(["some words of a sentence, and so on. " * 50] * 2200)
    model = toxicity.Model(np.arange(1000, dtype=np.int32), np.ones(1000), -4.0)
    for run in (quality.text_counts, lambda c: toxicity.scores(c, model)):
        run(column.slice(0, 10))
        tracemalloc.start()
        try:
            run(column)
            assert tracemalloc.get_traced_memory()[1] < 64 << 20
        finally:
            tracemalloc.stop()


def test_quality_rules_hand_a_kept_text_over_once(spark):
    docs = spark.createDataFrame([(1, "a few words " * 20), (2, None)], "doc_id long, text string")
    out = quality.counted(docs, ["doc_id", "text"], prefix="__q_")
    assert "__text__" not in out._jdf.queryExecution().analyzed().toString()
    assert [(r["doc_id"], r["text"], r["__q_n_words"]) for r in out.orderBy("doc_id").collect()] == [
        (1, "a few words " * 20, 60), (2, None, 0)]
    numbers = spark.createDataFrame([(1, 7)], "doc_id long, text long")
    assert [tuple(r)[:3] for r in quality.counted(numbers, ["doc_id", "text"], prefix="__q_").collect()] == [(1, 7, 1)]


def test_often_counts_like_brute_force():
    rng = np.random.default_rng(5)
    for size, kinds in ((0, 1), (1, 1), (2, 1), (3, 1), (50, 1), (1000, 300), (5000, 40), (4000, 4000)):
        h = rng.integers(0, kinds, size).astype(np.uint64)
        want, n = np.unique(h, return_counts=True)
        got, count = ngram_join.often(h.copy())
        assert got.tolist() == want[n > 2].tolist() and count.tolist() == n[n > 2].tolist()


def test_counting_shingles_takes_little_beside_its_chunks(monkeypatch):
    """A worker that counts 5 million words and as many shingles holds the two
    chunks and less than 64 MB; a text longer than a chunk is counted whole."""
    import tracemalloc
    found = {}

    class Taken(Exception):
        pass

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            found["run"] = run
            raise Taken

    def of(column):
        with pytest.raises(Taken):
            ngram_join.counted_order(Table(), ngram_join.Rule(5, 80, 100))
        return found["run"](iter([pa.RecordBatch.from_arrays([c], names=["text"]) for c in column]))

    column = [pa.array([" ".join(map(str, range(i, i + 1000)))] * 50) for i in range(0, 100_000, 1000)]
    assert len(list(of(column[:1]))) == 2
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in of(column)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) > 190_000 and peak < 2 * 8 * ngram_join._CHUNK + (64 << 20)

    monkeypatch.setattr(ngram_join, "_CHUNK", 1000)
    counts = collections.Counter()
    for b in of([pa.array(["a b c d e f g h " * 1000])]):
        for kind, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            counts[kind] += n
    assert counts == {0: 8000, 1: 7996}


def test_long_rows_reach_the_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('a few words ', 500) AS text")
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        runtime.ship(spark)
        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 3000 and max(r["bytes"] for r in got) < 4 << 20
        spark.conf.set(key, "100000")           # a bound of the session's own stays
        runtime.ship(spark)
        assert spark.conf.get(key) == "100000"
        # Results do not depend on the borders of batches.
        some = spark.createDataFrame([(i, t) for i, t in corner_texts() if i], "doc_id long, text string")
        rule = ngram_join.Rule(5, 80, 100)
        spark.conf.set(key, "1000")
        small = sorted(map(tuple, ngram_join.join_documents(some, rule).collect()))
        spark.conf.unset(key)
        assert small == sorted(map(tuple, ngram_join.join_documents(some, rule).collect()))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
