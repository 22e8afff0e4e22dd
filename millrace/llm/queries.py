"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, minhash_dedup, mixing, oracles, quality_classifier, quality_rules, sentencepiece_nbest, substring_dedup, token_counts, token_output, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_nbest.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_id_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_posteriors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_nbest,
        op2_embedding_dedup,
        op3_token_counts,
        op4_url_filters,
        op5_substring_dedup,
        op6_token_output,
        op7_quality_rules,
        op8_source_mixing,
        op9_minhash_dedup,
        op10_quality_classifier,
    )
}

#: The others (tokenizers, content cuts, a fitted model) cannot be written in SQL as it stands; the tests hold them against
#: brute force and the libraries.
ORACLES: dict[str, str] = {
    "op2_embedding_dedup": oracles.op2(),
    "op4_url_filters": oracles.op4(),
    "op7_quality_rules": oracles.op7(),
    "op8_source_mixing": oracles.op8(),
    "op9_minhash_dedup": oracles.op9(),
}
