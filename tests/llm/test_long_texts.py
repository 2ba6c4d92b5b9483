"""One text of 20 MB among short ones: what each operator says of it is known beforehand."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import decontaminate, kneser_ney, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup, token_records
from wayfarer.llm.common import shared_dir

N = 1_200_000  # words of 16 characters


@pytest.fixture(scope="module")
def long(spark):
    word = lambda i: F.lpad(F.lower(F.hex(F.xxhash64(i))), 16, "0")
    text = F.array_join(F.concat(F.transform(F.sequence(F.lit(1), F.lit(N)), word), F.transform(F.sequence(F.lit(101), F.lit(200)), word)), " ")
    passage = F.array_join(F.transform(F.sequence(F.lit(700_001), F.lit(700_050)), word), " ")
    rows = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("doc_id"), text.alias("text")), F.struct(F.lit(2).alias("doc_id"), F.concat(F.lit("so "), passage).alias("text")))).alias("r"))
    path = shared_dir(spark, "long")
    rows.select(F.col("r.doc_id").cast("long").alias("doc_id"), "r.text").write.parquet(path)
    return spark.read.parquet(path)


def test_repeats_in_a_long_text(long):
    got = {r.doc_id: r for r in substring_dedup.removed_repeats(long).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_words, got[2].n_removed) == (N + 100, 250, 51, 50)
    got = {r.doc_id: r for r in suffix_dedup.removed_repeats(long).collect()}
    assert got[1].n_bytes == 17 * (N + 100) - 1 and got[1].n_spans == 3 and got[1].n_removed - (100 * 17 + 100 * 17 - 1 + 50 * 17) in range(4)


def test_fingerprint_and_quality_of_a_long_text(long):
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(long).collect()}
    assert got[1].component_id == 1 and got[2].component_id == 2
    one = quality_rules.statistics(long).where("doc_id = 1").first()
    assert (one.n_words, one.word_chars, one.n_repeat_words, one.n_dup_lines, one.n_kinds) == (N + 100, 16 * (N + 100), 200, 0, N)


def test_scores_tokens_and_hits_of_a_long_text(spark, long):
    score = {r.doc_id: r for r in kneser_ney.scores(long).collect()}
    assert score[1].n_tokens == N + 101 and score[1].train_tokens == N + 101 + 52
    bench = spark.createDataFrame([(7, long.where("doc_id = 2").first().text)], "item_id long, text string")
    hit = {r.doc_id: r for r in decontaminate.contamination(long, bench).collect()}
    assert (hit[1].n_words, hit[1].n_hit, hit[2].n_hit) == (N + 100, 50, 51)
    path = shared_dir(spark, "long-records")
    token_records.write(long, public_tokenizers.path("word_bpe_49k.json"), path, shards=2)
    found = token_records.index(spark, path)
    sizes = {r.doc_id: r.n_tokens for r in found.collect()}
    assert {r.doc_id: len(r.ids) for r in token_records.read_at(found).collect()} == sizes and sizes[1] > N


CJK = "".join(chr(0x4E00 + (k * 7919 + k // 11) % 20000) for k in range(5_000))


def _grown(make, texts):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text in texts:
        make(text)
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


def test_texts_without_spaces_fill_no_cache():
    import pyarrow as pa

    parts, words = sentencepiece_codec.parts_of(public_tokenizers.path("piece_bpe_32k.model")), token_records.words_of(public_tokenizers.path("word_bpe_49k.json"))
    texts = [CJK[k % 5000 :] + CJK[: k % 5000] for k in range(1, 400)]
    assert _grown(parts.of, texts[:150]) < 100 and parts.size < sentencepiece_codec.KEPT_BYTES
    assert _grown(lambda t: words.of(pa.array([t])), texts) < 100 and words.spelled.used < token_records.KEPT_BYTES


def test_one_word_of_20_mb(spark):
    import hashlib
    import zlib

    import numpy as np
    import sentencepiece
    from tokenizers import Tokenizer

    text = "abcdefgh" * 2_500_000
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").union(spark.range(1).select(F.lit(2).cast("long"), F.expr("repeat('abcdefgh', 2500000)")))
    got = {r.doc_id: r for r in sentencepiece_codec.digests(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    ids = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(text)
    assert got[2].n_tokens == len(ids) and got[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    path = shared_dir(spark, "one-word")
    token_records.write(df, public_tokenizers.path("word_bpe_49k.json"), path, shards=2)
    found = {r.doc_id: r for r in token_records.starts(token_records.index(spark, path)).collect()}
    ids = [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 1]
    assert found[2].n_tokens == len(ids) and found[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
