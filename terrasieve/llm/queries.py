"""One query for each operator over its whole table, and the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasieve.llm import chat, lm_scoring, mixing, near_dedup, oracles, packing, quality_classifier, quality_rules, top_k, toxicity, url_filters
from terrasieve.llm.common import table


def word_tokenizer() -> str:
    """The path of the public word-piece vocabulary; packing takes any such path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns(table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op6_exact_top_k": oracles.TOP_K,
    "op9_chat_formatting": chat.ORACLE_SQL,
}
