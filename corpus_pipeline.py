"""Training-data pipeline: five stages over ``documents``, each a stored table
that the next one reads.

1. toxicity: documents that score 0.7 or more go
2. quality rules: documents that fail the base rule or the posterior go
3. n-gram Jaccard join: of documents that link at five-word shingles and a
   similarity of 0.8, the one with the least id stays
4. substring dedup: passages of 20 words that start earlier elsewhere are cut
   from the texts
5. packing: what is left becomes sequences of 2048 ids

All but the last return the columns of ``documents``.  Nulls, empty texts and
tables, ties, repeated rows and further columns are handled as each operator's
docstring says; further columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import ngram_join, packing, quality, substring_dedup, toxicity
from revlens.llm.runtime import written

NEAR_DUPLICATES = ngram_join.Rule(words=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, NEAR_DUPLICATES)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

# No SQL: a trained model, a tokenizer and a packing are not SQL expressions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
