"""Each operator on the smallest tables, and shared helpers at their limits."""

import public_tokenizers
import pytest
from conftest_llm import SCHEMA

from wayfarer.llm import components, decontaminate, kneser_ney, quality_rules, secrets, sentencepiece_codec, simhash_dedup, substring_dedup, suffix_dedup, token_records
from wayfarer.llm.common import shared_dir

PROSE = " ".join(f"word{k}" for k in range(60))
TABLES = {
    "one null": [(1, None)], "one empty": [(1, "")], "one word": [(1, "a")], "no id": [(None, PROSE)], "no id, no text": [(None, None)],
    "two equal rows": [(1, PROSE), (1, PROSE)], "two equal texts": [(1, PROSE), (2, PROSE)], "equal rows without ids": [(None, PROSE), (None, PROSE)], "two nulls": [(None, None), (None, None)],
}


def written(spark, df):
    path = shared_dir(spark, "edge-records")
    token_records.write(df, public_tokenizers.path("word_bpe_49k.json"), path)
    return token_records.starts(token_records.index(spark, path))


def benchmark(spark):
    return spark.createDataFrame([(1, PROSE)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")


OPERATORS = {
    "op1": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "op2": lambda s, d: sentencepiece_codec.digests(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op3": lambda s, d: secrets.scanned(d),
    "op4": lambda s, d: simhash_dedup.near_duplicates(d),
    "op5": lambda s, d: suffix_dedup.removed_repeats(d),
    "op6": written,
    "op7": lambda s, d: kneser_ney.scores(d),
    "op8": lambda s, d: quality_rules.judged(d, labels(s)).drop("k1", "k2"),
    "op9": lambda s, d: substring_dedup.removed_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_small_tables_give_a_row_for_each_row(spark, name):
    for case, rows in TABLES.items():
        df = spark.createDataFrame([(d, t, "xx", "s", None, "k", "s", 1, "f", "c") for d, t in rows], SCHEMA).coalesce(1)
        got = OPERATORS[name](spark, df).collect()
        assert sorted(r.doc_id is None for r in got) == sorted(d is None for d, _ in rows), case
        assert len({tuple(r)[1:] for r in got}) == 1 or name in ("op4", "op6"), case


@pytest.mark.parametrize("stage", [lambda s, d: decontaminate.clean(d, benchmark(s).limit(0)), lambda s, d: secrets.redacted(d), lambda s, d: quality_rules.passing(d, labels(s))])
def test_stages_keep_clean_rows_and_their_columns(spark, stage):
    for rows in TABLES.values():
        df = spark.createDataFrame([(d, t, "xx", "s", None, "k", "s", 1, "f", "c") for d, t in rows], SCHEMA)
        got = stage(spark, df)
        kept = got.collect()
        assert got.columns == df.columns and len(kept) in (len(rows), 0) and (len(kept) == len(rows) or len(rows[0][1] or "") < 100)


def test_a_hub_of_many_links_is_one_component(spark):
    star = spark.range(1, 300_001).selectExpr("0L as a", "id as b")
    assert components.stars(star, "hub").selectExpr("count(*)", "max(b)").first()[:] == (300_000, 0)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "spark://host:7077" if key == "spark.master" else default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")
