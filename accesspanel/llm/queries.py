"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from accesspanel.llm import (
    bpe,
    decontamination,
    golay_simhash,
    language_id,
    lexical_search,
    line_templates,
    lm_scoring,
    mixing,
    prefix_trie,
    quality_cnn,
    quality_rules,
    repeated_passages,
    sharding,
)
from accesspanel.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op2_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(documents(spark, sf_dir))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeated(documents(spark, sf_dir))


def op5_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_templates.drop_recurring(docs)


def op11_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op12_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Query] = {
    "op1_cross_parsing": op1_cross_parsing,
    "op2_benchmark_templates": op2_benchmark_templates,
    "op3_golay_simhash": op3_golay_simhash,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_best_fit_shards": op5_best_fit_shards,
    "op6_backtracking_bpe": op6_backtracking_bpe,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_line_templates": op10_line_templates,
    "op11_hypergeometric_mix": op11_hypergeometric_mix,
    "op12_fp_tree_search": op12_fp_tree_search,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op10_line_templates": line_templates.ORACLE_SQL,
    "op12_fp_tree_search": lexical_search.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
