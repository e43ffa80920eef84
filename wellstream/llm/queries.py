"""Registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wellstream.llm import decontaminate, hard_negatives, language, manifest, mixture, near_dup, order_minhash, passages, quality, quotes, secrets, shards, toxicity

#: Links of op2: shared shingles in per cent of the union.
NEAR_PERCENT = 85


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(summary: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: summary(*(_table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": _of(decontaminate.summary, "documents", "benchmark"),
    "op2_minhash_near_dedup": _of(lambda documents: near_dup.near_duplicates(documents, NEAR_PERCENT), "documents"),
    "op3_document_fingerprints": _of(order_minhash.with_next, "documents"),
    "op4_toxicity": _of(toxicity.summary, "documents", "labels"),
    "op5_quality_classifier": _of(quality.summary, "documents", "labels"),
    "op6_substring_dedup": _of(passages.summary, "documents"),
    "op7_secret_scan": _of(secrets.summary, "documents"),
    "op8_quotation_linking": _of(quotes.summary, "conversations"),
    "op9_sharding": _of(shards.summary, "documents"),
    "op10_source_mixture": _of(mixture.summary, "documents"),
    "op11_merkle_manifest": _of(manifest.summary, "documents"),
    "op12_language_id": _of(language.summary, "documents"),
    "op13_hard_negatives": _of(hard_negatives.summary, "embeddings"),
}
