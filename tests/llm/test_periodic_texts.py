"""Repeats in periodic texts, which have an anchor at each byte or word: as brute force says, and with few anchors."""

import hashlib
import random

import pyarrow as pa
import pytest
from conftest_llm import words
from pyspark.sql import functions as F

from wayfarer.llm import substring_dedup, suffix_dedup


def texts():
    rng, out = random.Random(9), []
    prose = lambda n: " ".join(rng.choice(("alpha", "b", "gamma", "dd", "eps")) + str(rng.randrange(300)) for _ in range(n))
    for k in range(12):
        p = rng.choice([1, 2, 3, 7, 31, 50, 90])
        unit = "".join(rng.choice("abcd ") for _ in range(p))
        out.append(prose(rng.randrange(30)) + " " + (unit * 3000)[: rng.choice([150, 250, 420, 900, 2500])] + " " + prose(rng.randrange(30)))
    for k in range(12):
        unit = [rng.choice(("na", "ba", "x", "spam")) for _ in range(rng.choice([1, 2, 3, 9, 20]))]
        out.append(prose(rng.randrange(40)) + " " + " ".join((unit * 400)[: rng.choice([20, 40, 76, 120, 300])]) + "\n" + prose(rng.randrange(40)))
    return [*out, out[3][20:], out[15] + " " + out[3], "a" * 1000, "a" * 230, "a" * 201, "a" * 200 + "b", "na " * 80, "x " + "na " * 60]


def removed(rows, units, size, joined):
    seen = {}
    for k, u in enumerate(rows):
        for i in range(len(u) - size + 1):
            seen.setdefault(tuple(u[i : i + size]), []).append((k, i))
    gone = [[False] * len(u) for u in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + size] = [True] * size
    return {k: (sum(g), hashlib.sha256(joined(x for x, out in zip(u, g, strict=True) if not out)).hexdigest()) for k, (u, g) in enumerate(zip(rows, gone, strict=True))}


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_periodic_texts_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(substring_dedup, "PART", part // 7 + 40)
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.removed_repeats(df).collect()}
    assert got == removed([t.encode() for t in rows], None, 200, bytes)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.removed_repeats(df).collect()}
    assert got == removed([words(t) for t in rows], None, 35, lambda w: " ".join(w).encode())


def test_anchors_of_a_long_run_are_few():
    for text in ("a" * 3_000_000, "ab cd efg" * 300_000, "".join(chr(97 + k * k % 23) for k in range(50)) * 60_000):
        part = pa.record_batch([pa.array([text, "b" + text[:500]]), pa.array([1, 2], pa.int64()), pa.array([3, 4], pa.int64())], names=["text", "k1", "k2"])
        assert len(suffix_dedup._anchors(200, 32)(part)) < 3_000
    part = pa.record_batch([pa.array(["spam " * 900_000]), pa.array([1], pa.int64()), pa.array([3], pa.int64())], names=["text", "k1", "k2"])
    assert len(substring_dedup._seeds(35, 5)(part)) < 300


def test_20_mb_of_one_letter_and_of_one_word(spark):
    df = spark.createDataFrame([(1, "plain")], "doc_id long, text string").union(spark.range(1).select(F.lit(2).cast("long"), F.expr("repeat('a', 20000000)")))
    got = {r.doc_id: r for r in suffix_dedup.removed_repeats(df).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[1].n_removed) == (20_000_000, 1, 0)
    df = spark.createDataFrame([(1, "plain")], "doc_id long, text string").union(spark.range(1).select(F.lit(2).cast("long"), F.expr("repeat('spam ', 4000000)")))
    got = {r.doc_id: r for r in substring_dedup.removed_repeats(df).collect()}
    assert (got[2].n_words, got[2].n_removed, got[1].n_removed) == (4_000_000, 4_000_000, 0)
