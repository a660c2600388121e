"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, language_id, lexical_search, line_dedup, media_columns, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of the public vocabularies.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json", limit=512)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(documents(spark, sf_dir)).drop("kept", "removed_spans")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_media(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json", with_ids=False)


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_quality_rules, op3_suffix_dedup, op4_quality_classifier, op5_line_dedup, op6_byte_bpe, op7_language_id, op8_ngram_join, op9_media_columns, op10_mixing]
    found += [op11_lexical_search, op12_collocations, op13_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_join": ngram_join.sql(), "op10_mixing": mixing.sql(), "op11_lexical_search": lexical_search.sql(), "op12_collocations": collocations.sql()}
