"""The corpus pipeline: documents in, token ids out. Part of the training-data subpackage.

Stages: rejected documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked in what is left, and the rest is encoded. SQL can't express the learned rules, the
tiled comparison or the encoding, so there is no ORACLE_SQL; tests/llm compares with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import decontaminate, quality_rules, secrets, sentencepiece_codec, simhash_dedup
from wayfarer.llm.common import stash, table


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", passing), ("SimHash near-dedup", one_of_each), ("decontamination", clean), ("secret scan", masked), ("SentencePiece", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs, f"pipeline-{k}") if k < len(STAGES) - 1 else docs
    return docs
