"""The pipeline on the smallest tables, stage by stage, against plain versions."""

import pytest
import sentencepiece
from test_dedup import grouped
from test_text import PIECES, contamination

import __spark_entry__
import corpus_pipeline
from wayfarer.llm import quality_rules
from wayfarer.llm.common import stash, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    out = [stash(table(spark, SF, "documents"), "t")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(stash(stage(spark, out[-1], SF), f"t{k}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_rejected_documents_go(spark, kept):
    good = quality_rules.judged(kept[0], table(spark, SF, "labels")).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in good) == sorted(d for d, _ in pairs(kept[1])) and kept[1].count() < kept[0].count()


def test_one_of_each_group_stays(kept):
    assert sorted(d for d, _ in pairs(kept[2])) == sorted({c for _, _, c in grouped(pairs(kept[1]))})


def test_contaminated_documents_go(spark, kept):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = contamination(pairs(kept[2]), items, 10)
    assert sorted(d for d, _ in pairs(kept[3])) == sorted(x[0] for x in want if not x[5])


def test_all_but_the_last_stage_keep_the_columns_of_documents(kept):
    assert all(k.columns == kept[0].columns for k in kept[1:-1])


def test_the_last_stage_encodes_the_masked_texts(kept):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: list(r.ids) for r in kept[-1].collect()} == {d: lib.encode(t) for d, t in pairs(kept[-2])}


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
