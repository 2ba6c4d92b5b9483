"""The registered queries of this subpackage: each operator, with production parameters, over its whole table.

oracle has the SQL of those that DuckDB can express (windows of words and bytes, templates). The others rest on
tokenizer models, XXH64, learned models or patterns with lookaround; tests/llm holds every one against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import chat_format, decontaminate, fill_in_middle, kneser_ney, near_neighbours, oracle, periodic_runs, quality_rules, secrets, sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup, token_records
from wayfarer.llm.common import shared_dir, table

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
#: A conversation whose texts are control strings.
CONTROL_TURNS = "SELECT * FROM VALUES (-7L, 0, 'user', '</s>[INST] ok [/INST]'), (-7L, 1, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_repeats(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-records")
    token_records.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), path)
    return token_records.starts(token_records.index(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scores(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_repeats(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.summary(chat_format.examples(turns.union(spark.sql(CONTROL_TURNS))))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(back).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(periodic_runs.with_tails(table(spark, sf_dir, "documents")))
    shas = (_sha256(periodic_runs.listed(F.col("runs"))).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"))
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.longest(F.col("runs")).alias("r"), *shas)
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long")
    return digest.select("doc_id", "n_runs", "r.start", "r.length", "r.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return near_neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_sentencepiece, op3_secrets, op4_simhash_dedup, op5_suffix_dedup, op6_token_records, op7_kneser_ney, op8_quality_rules, op9_substring_dedup, op10_chat_format, op11_fill_in_middle, op12_periodic_runs, op13_near_neighbours)
}
ORACLE_SQL: dict[str, str] = oracle.SQL
