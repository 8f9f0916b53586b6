"""The registered queries of this subpackage: each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triflux.llm import (
    divergence,
    fingerprints,
    hard_negatives,
    langid,
    licenses,
    mixing,
    near_dup,
    packing,
    pii,
    secret_scan,
    substring_dedup,
    token_files,
    top_k,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return top_k.top_k(vectors, vectors.where(top_k.is_query()))


def _hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_token_files": lambda s, d: token_files.token_digest(s, _documents(s, d)),
    "op2_secret_scan": lambda s, d: secret_scan.scan(_documents(s, d)),
    "op3_top_k_search": _top_k,
    "op4_best_fit_packing": lambda s, d: packing.pack(_documents(s, d))[1],
    "op5_near_duplicates": lambda s, d: near_dup.near_duplicates(_documents(s, d), words=4),
    "op6_personal_data": lambda s, d: pii.scan(_documents(s, d)),
    "op7_source_mixing": lambda s, d: mixing.mix_report(_documents(s, d)),
    "op8_license_scan": lambda s, d: licenses.scan(_documents(s, d)),
    "op9_language_id": lambda s, d: langid.identify(_documents(s, d)),
    "op10_fingerprints": lambda s, d: fingerprints.edited_fingerprints(_documents(s, d)),
    "op11_hard_negatives": _hard_negatives,
    "op12_substring_dedup": lambda s, d: substring_dedup.removal_digest(_documents(s, d)),
    "op13_source_divergence": lambda s, d: divergence.audit(_documents(s, d)),
}

ORACLES: dict[str, str] = {
    "op3_top_k_search": top_k.SQL,
    "op7_source_mixing": mixing.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_substring_dedup": substring_dedup.SQL,
    "op13_source_divergence": divergence.SQL,
}
