"""The dealt operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import collocations, hard_negatives, language_id, line_dedup, media, mixing, near_dup, packing, quality_model, quality_rules, secret_scan, sharding, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_docs(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), TOKENIZER)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_docs(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_digest(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules_digest(_docs(spark, sf_dir))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.dedup_digest(_docs(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_docs(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_docs(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_digest(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [op1_media_columns, op2_best_fit_packing, op3_line_dedup, op4_secret_scan, op5_quality_classifier, op6_quality_rules, op7_minhash_near_dup, op8_source_mixing, op9_sharding, op10_toxicity, op11_hard_negatives, op12_phrase_collocations, op13_language_id, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict[str, str]:
    return {"op11_hard_negatives": hard_negatives.ORACLE, "op12_phrase_collocations": collocations.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op4_secret_scan": secret_scan.ORACLE, "op6_quality_rules": quality_rules.ORACLE}
