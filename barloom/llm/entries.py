"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    centroid_clustering,
    embedding_dedup,
    exact_topk,
    license_scan,
    mixing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    url_filters,
)
from barloom.llm.common import table
from barloom.llm.lm_scoring import fold_scores
from barloom.llm.minhash_dedup import near_duplicates
from barloom.llm.token_counts import token_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scores(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.mixture(table(spark, sf_dir, "documents")).select(*columns)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.looped_runs(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.digested(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_lm_scoring,
        op3_url_filters,
        op4_token_counts,
        op5_license_scan,
        op6_embedding_near_dedup,
        op7_minhash_near_dedup,
        op8_quality_classifier,
        op9_mix_sources,
        op10_sentencepiece,
        op11_exact_topk,
        op12_periodic_runs,
        op13_centroid_clustering,
    )
}
SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op3_url_filters": url_filters.oracle(),
    "op5_license_scan": license_scan.oracle(),
    "op11_exact_topk": exact_topk.oracle(),
    "op13_centroid_clustering": centroid_clustering.oracle(),
}
