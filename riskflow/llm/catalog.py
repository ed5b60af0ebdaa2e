"""Queries opN_<name> of this subpackage, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskflow.llm import (
    best_fit,
    decontaminate,
    hard_negatives,
    language_model,
    near_duplicates,
    personal_data,
    quality_classifier,
    quality_rules,
    repeated_passages,
    sentence_pieces,
    source_divergence,
    token_counts,
    url_filters,
)
from riskflow.session import ensure_conf
from riskflow.sources.tables import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_token_counts, op3_sentence_pieces, op4_decontaminate, op5_quality_rules, op6_quality_classifier,
    op7_near_duplicates, op8_language_model, op9_personal_data, op10_repeated_passages,
    op11_source_divergence, op12_hard_negatives, op13_best_fit_packing)}


def _wrap(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ensure_conf(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _wrap(v) for k, v in QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.oracle(), "op11_source_divergence": source_divergence.oracle(), "op12_hard_negatives": hard_negatives.oracle()}
