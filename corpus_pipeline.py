"""Documents through five operators: quality rules, near-dedup, substring dedup, source mixing, SentencePiece encoding.

Each stage takes all that its predecessor kept and its decisions take effect; its result is written as Parquet and read
again as the next stage's input.

Defined results: null and empty texts have too few words for the quality rules and leave there; very long texts go through
whole. Of rows that share a doc_id (null ids too) quality judges each by itself, near-dedup leaves one row of each group,
and the mix takes each of the rest as a document of its own. Empty tables give an empty result. Columns beside those of
documents stay until the last stage, which has the ids in their place, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import minhash_dedup, mixing, quality_rules, sentencepiece_nbest, substring_dedup
from millrace.llm.common import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similarity 0.8 or more on five-word shingles."""
    return minhash_dedup.keep_first_of_groups(docs, percent=80)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier part of the same one, holds."""
    return substring_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped weights of their sources take them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's best segmentation."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return sentencepiece_nbest.encode(rows, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_cut),
    ("source mixing", mix),
    ("SentencePiece encoding", encode),
]

#: The stages cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
