"""The operators as stages of the corpus pipeline: (spark, docs, sf_dir) in, a DataFrame out. All but the last return the
columns of `docs`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import minhash_dedup, mixing, sentencepiece_codec
from barloom.llm import quality_classifier as classifier
from barloom.llm import quality_rules as rules
from barloom.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score below the threshold."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy."""
    return rules.keep_passing(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of five-word similarity of 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, and whether they give it again."""
    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
