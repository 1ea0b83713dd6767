"""One query per operator over the given tables, and DuckDB statements for
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit, chat, fingerprints, merkle, ngram_join, packing, periodic_runs, quality, sentencepiece_sampling,
               sharding, substring_dedup, toxicity, warc)
from .runtime import new_path

_B = {}
# Looked-up chunks of a worker where a query does nothing but tokenize and pack.
CHUNK_BYTES = 320 << 20


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _B[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), cache_bytes=CHUNK_BYTES)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


@_query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"), radius=fingerprints.NEAR)


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.without_repeats(table(spark, sf_dir, "documents")))


@_query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.format_conversations(rows.unionByName(planted))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "posterior")


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), new_path(spark, "slot_map"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where the CRC-32 of the id ends in 0, the text's words
    from one on are a period that repeats in place of what follows."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (crc % 10).alias("h"), F.floor(crc / 10).cast("long").alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n = F.size("w").cast("long")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cast = {c: F.col(c).cast("int") for c in ("n", "a", "p")}
    period = F.slice("w", cast["a"] + 1, cast["p"])
    again = F.array_repeat(period, F.expr("cast((n - a) div p + 1 as int)"))
    words = F.slice(F.concat(F.slice("w", F.lit(1), cast["a"]), F.flatten(again)), F.lit(1), cast["n"])
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_periods(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.back")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.back) div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    leaf = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    tampered = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    probe = F.unhex(F.when(even, merkle.leaf_digest(tampered)).otherwise(leaf))
    rows = merkle.build(docs, F.col("source"), F.col("doc_id"), leaf, carry={"probe": probe})
    seen = merkle.check(F.col("probe"), F.col("path"), F.col("root"))
    rows = rows.select("key", "leaf", "subroot", "root", seen.proof.alias("proof"), seen.folded.alias("folded"))
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded")}
    return rows.select(
        F.col("key").alias("doc_id"), *[text[c].alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.encode("proof", "UTF-8"), 256).alias("proof_sha256"), text["folded"].alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


@_query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_fit.pack_documents(table(spark, sf_dir, "documents"), cache_bytes=CHUNK_BYTES)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_B)


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
    len(role) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]')) AS role_len,
    len(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]')) AS text_len
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN opens THEN 22 + role_len ELSE 8 END + text_len + CASE WHEN closes THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(hex, (i * 5 // 4 + 1)::BIGINT, 2) || repeat('0', greatest(0, i * 5 // 4 - 38)::BIGINT))::INT
     >> (3 - (i * 5) % 4)::INT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM m
"""


# CRC-32 bit by bit: a byte is joined in by xor, each -1 is one shift.
OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda d: list_concat([ascii(d)::BIGINT], list_transform(generate_series(1, 8), lambda i: -1::BIGINT))))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
digests AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0
      THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS probe
  FROM (SELECT *, list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
    lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '') AS head FROM docs)),
leaves AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM digests WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT source, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY source, lvl, n, idx // 3),
subroots AS (
  SELECT source, h, lvl AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM tops WHERE n > 1 GROUP BY lvl, n, idx // 3),
up AS (
  SELECT source, lvl AS lev, idx, h FROM nodes WHERE n > 1),
steps AS (
  SELECT l.rid, u.lev, u.idx < l.idx // power(3, u.lev)::BIGINT AS before, u.idx, u.h
  FROM leaves l JOIN up u ON u.source IS NOT DISTINCT FROM l.source
    AND u.idx // 3 = l.idx // power(3, u.lev + 1)::BIGINT AND u.idx <> l.idx // power(3, u.lev)::BIGINT
  UNION ALL
  SELECT l.rid, s.height + t.lvl, t.idx < s.idx // power(3, t.lvl)::BIGINT, t.idx, t.h
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n > 1
    AND t.idx // 3 = s.idx // power(3, t.lvl + 1)::BIGINT AND t.idx <> s.idx // power(3, t.lvl)::BIGINT),
sides AS (
  SELECT rid, lev, coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE before), '') AS lft,
    coalesce(string_agg(h, '' ORDER BY idx) FILTER (WHERE NOT before), '') AS rgt
  FROM steps GROUP BY rid, lev),
heights AS (
  SELECT l.rid, l.probe, s.height + (SELECT max(lvl) FROM tops) AS height
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source),
folded AS (
  SELECT rid, 0::BIGINT AS lev, height, probe AS h FROM heights
  UNION ALL
  SELECT f.rid, f.lev + 1, f.height, sha256(coalesce(s.lft, '') || f.h || coalesce(s.rgt, ''))
  FROM folded f LEFT JOIN sides s ON s.rid = f.rid AND s.lev = f.lev WHERE f.lev < f.height)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root,
  sha256(coalesce((SELECT string_agg(s.lft || s.rgt, '' ORDER BY s.lev) FROM sides s WHERE s.rid = l.rid), '')) AS proof_sha256,
  f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source
JOIN folded f ON f.rid = l.rid AND f.lev = f.height, (SELECT h FROM tops WHERE n = 1) t
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL, "op7_chat_formatting": OP7_SQL, "op12_merkle_manifest": OP12_SQL}
