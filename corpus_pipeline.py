"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns what it keeps in those
columns; the last returns packed pieces. run() writes each stage's result as a Parquet table in the shared folder and
reads it back for the next, so no stage is computed twice and a lost executor costs one stage at most.

All stages take null texts and empty tables; a null text has no words, so the quality rules reject it. Rows that repeat a
doc_id, or have none, are documents of their own until near-dedup, which keeps one row of equal or nearly equal ones. Columns beyond
those of documents pass through unchanged up to packing, whatever their names. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.llm import mixing, near_dedup, packing, quality_rules, toxicity
from terrasieve.llm.common import fold_of, free_name, table, written
from terrasieve.llm.queries import word_tokenizer

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC."""
    index = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold_of(F.col("doc_id"), 3) != 1)
    name = free_name(docs, "toxicity")
    return toxicity.scored(docs, index, name).where(F.col(name) < TOXIC).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    rules = quality_rules.plan(docs, quality_rules.BASE_RULES + quality_rules.STYLE_RULES)
    return docs.where(quality_rules.first_failed(rules).isNull())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with its least id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; repeats are equal rows."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the toxicity and packing stages; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
