"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worklens.llm import (
    bpe,
    exact,
    hard_negatives,
    lm_suffix_tree,
    mixing,
    oracle,
    quality_fm,
    rules,
    simhash,
    spelling,
    suffix_levels,
    token_files,
    toxicity_mil,
    windows,
)
from worklens.llm.tables import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        table(spark, sf_dir, "documents"),
        columns=("n_tokens", "ids_sha256", "decoded_sha256"),
        keep_words=True,
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).selectExpr(
        "row.doc_id AS doc_id",
        "topic",
        "tokens AS n_tokens",
        "round(weight, 9) AS cell_weight",
        "p AS probability",
        "kept",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_mil.score(docs, model)


def op8_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(table(spark, sf_dir, "documents"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shared_passages(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_groups(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), garble=31)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding"
    )
    return hard_negatives.hard_negatives(vectors, "vec_id % 100 = 0")


def op13_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.without_repeats(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_bytes",
        "n_bytes - length(kept) AS n_removed",
        "CAST(size(spans) AS LONG) AS n_spans",
        "sha2(kept, 256) AS kept_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per corpus operator."""
    named = (
        op1_quality_classifier,
        op2_byte_bpe,
        op3_mixing,
        op4_simhash,
        op5_quality_rules,
        op6_suffix_tree,
        op7_toxicity,
        op8_id_planes,
        op9_compact_windows,
        op10_exact_dedup,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_suffix_levels,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return oracle.oracle_sql()
