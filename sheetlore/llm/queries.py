"""Registered corpus queries: one per operator, applied to its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from sheetlore.llm.bpe_automaton import encode_digests
from sheetlore.llm.decontamination import contaminated
from sheetlore.llm.exact_dedup import exact_duplicates
from sheetlore.llm.language_cnn import languages
from sheetlore.llm.license_scan import license_paragraphs
from sheetlore.llm.merkle_log import MERKLE_SQL, merkle_manifest
from sheetlore.llm.near_dedup import near_duplicates
from sheetlore.llm.quality_trees import quality_scores
from sheetlore.llm.spelling_groups import SPELLING_SQL, spelling_variants
from sheetlore.llm.suffix_dedup import repeated_passages
from sheetlore.llm.token_counts import context_summary, length_histogram
from sheetlore.llm.token_shards import training_shards
from sheetlore.llm.toxicity_fm import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return context_summary(length_histogram(_table(spark, sf_dir, "documents"), vocabulary))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM texts WINDOW g AS (PARTITION BY body)
"""


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_paragraphs(_table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_bpe_automaton": op3_bpe_automaton,
        "op4_license_scan": op4_license_scan,
        "op5_quality_trees": op5_quality_trees,
        "op6_language_cnn": op6_language_cnn,
        "op7_near_dedup": op7_near_dedup,
        "op8_token_shards": op8_token_shards,
        "op9_toxicity_fm": op9_toxicity_fm,
        "op10_decontamination": op10_decontamination,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_suffix_dedup": op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_merkle_manifest": MERKLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
