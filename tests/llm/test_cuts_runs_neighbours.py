"""Fill-in-middle cuts, periodic runs and nearest neighbours against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import SCHEMA, same
from pyspark.sql import functions as F

from wayfarer.llm import fill_in_middle, near_neighbours, periodic_runs, queries

TOKEN, WORD = re.compile(r"[A-Za-z]+|[^A-Za-z]"), re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    w = TOKEN.findall(text)
    g = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = "".join(w[:lo]), "".join(w[lo:hi]), "".join(w[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    return doc_id, len(w), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def op11(df):
    made = fill_in_middle.transformed(df)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256), F.sha2(back.cast("binary"), 256)).collect()


def test_cuts_of_the_corpus(docs, rows):
    same(op11(docs), [cut(d, t) for d, t in rows])


def test_cuts_of_awkward_texts(spark):
    rng = random.Random(3)
    texts = ["<<S", "a<P>b", "x<", "<M", "é漢a😀b", "ab" * 5000, "漢" * 9000, "a1" * 6000, "\0\n a"] + ["".join(rng.choice("aB<SM>é漢😀 \n") for _ in range(rng.randrange(12000))) for _ in range(40)]
    data = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    same(op11(spark.createDataFrame(data, "doc_id long, text string").repartition(3)), [cut(d, t) for d, t in data])


def test_cuts_cross_chunks_and_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_in_middle, "CHUNK", 4)
    monkeypatch.setattr(fill_in_middle, "BLOCK", 12)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé漢 -") for _ in range(rng.randrange(60))) for _ in range(200)]
    draws = [np.array([rng.randrange(1000) for _ in texts]) for _ in range(2)]
    n, out = fill_in_middle.cuts(pa.array(["skipped", *texts])[1:], draws)
    for text, size, own, a, b in zip(texts, n, out, *draws, strict=True):
        w = TOKEN.findall(text)
        want = sorted(len("".join(w[: x % (len(w) + 1)])) for x in (a, b))
        assert size == len(w) and own.tolist() == want


def runs(w):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(12, 2 * q) and not any(all(w[i + k] == w[i + k + r] for k in range(size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def tailed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    a = h // 10 % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def collapsed(doc_id, text):
    w = tailed(doc_id, WORD.findall(text or ""))
    found = runs(w)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def op12(spark, df, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return queries.op12_periodic_runs(spark, "").collect()


def test_runs_of_the_corpus(spark, docs, rows, monkeypatch):
    short = docs.where("doc_id is null or doc_id <> 302")  # 8,000 words are too many for the plain version
    same(op12(spark, short, monkeypatch), [collapsed(d, t) for d, t in rows if d != 302])


def test_runs_of_every_kind(spark, monkeypatch):
    rng, data = random.Random(5), []
    for k in range(400):
        w = [f"w{rng.randrange(rng.choice([1, 2, 2, 3, 40]))}" for _ in range(rng.choice([0, 11, 12, 40, 150]))]
        for _ in range(rng.randrange(3)):
            p, a = rng.randrange(1, 20), rng.randrange(len(w) + 1)
            w = w[:a] + (w[a : a + p] * 6)[: rng.randrange(70)] + w[a:]
        data.append((k, " ".join(w + w[: rng.randrange(5)] + w) if rng.random() < 0.3 else "\n".join(w)))
    same(op12(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), monkeypatch), [collapsed(d, t) for d, t in data])


def test_runs_of_long_texts():
    rng = random.Random(6)
    once = [rng.randrange(900) for _ in range(100_000)]
    for w, want in (([7] * 3_000_000, [(0, 3_000_000, 1)]), ([1] * 90_000 + [2] + [1] * 80_000, [(0, 90_000, 1), (90_001, 80_000, 1)]), (list(range(50)) * 40_000, [(0, 2_000_000, 50)]), (once + once, [(0, 200_000, 100_000)])):
        found = periodic_runs.runs_of(np.array(w), np.array([0, len(w)]))
        assert [tuple(int(x) for x in r) for r in zip(*found, strict=True)] == want


@pytest.mark.parametrize("name", ["op11", "op12"])
def test_small_tables(spark, name):
    operator = {"op11": fill_in_middle.transformed, "op12": periodic_runs.collapsed}[name]
    for data in ([], [(1, None)], [(None, None), (None, "")], [(1, "a"), (1, "a")]):
        df = spark.createDataFrame([(d, t, "xx", "s", None, "k", "s", 1, "f", "c") for d, t in data], SCHEMA).withColumns({c: F.lit(1) for c in ("n", "form", "output", "runs", "h1")})
        got = operator(df).collect()
        assert len(got) == len(data)


def brute(vectors, k=20):
    usable = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dims = max((len(v) for _, v in usable), default=0)
    rows = [(i, np.r_[v, np.zeros(dims - len(v))]) for i, v in usable]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            out.setdefault(i, []).append(sorted(((-float(np.dot(v, x)), j) for j, x in rows if j != i))[:k])
    return out


def searched(spark, vectors, kind="array<float>", **more):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], f"vec_id long, embedding {kind}, score int, rank int, cell int").repartition(3)
    got = {}
    for r in near_neighbours.nearest(df.where("vec_id % 20 = 0"), df, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_neighbours_of_clusters_copies_and_lengths(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24))
    base = centres[rng.integers(30, size=3000)] * rng.uniform(0.5, 2, (3000, 1)) + 0.15 * rng.normal(size=(3000, 24))
    base[1000:1900] = 5 * base[1000]  # a third are copies, and longer than others
    vectors = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    got, want, hits, total = searched(spark, vectors), brute(vectors), 0, 0
    for i, (near,) in want.items():
        assert [r for r, _, _ in got[i]] == list(range(1, len(got[i]) + 1)) and len(got[i]) <= 20
        score = {j: -s for s, j in near}
        assert all(abs(s - score[j]) < 1e-9 for _, j, s in got[i] if j in score)
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
        hits, total = hits + len({j for _, j, _ in got[i]} & set(score)), total + len(score)
    assert set(got) == set(want) and hits / total >= 0.9
    assert [j for _, j, _ in got[1000]] == [j for j in range(1001, 1021)] and [j for _, j, _ in got[1020]][:19] == list(range(1000, 1019))


def test_several_functions_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_neighbours, "PIECE", 50)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 12))
    vectors = [(k, v.tolist()) for k, v in enumerate(base)]
    for functions in (1, 2):
        got, want = searched(spark, vectors, "array<double>", functions=functions, k=10), brute(vectors, 10)
        hits = sum(len({j for _, j, _ in got.get(i, [])} & {j for _, j in near}) for i, (near,) in want.items())
        assert hits / (10 * len(want)) >= 0.9


def test_neighbours_of_awkward_rows(spark):
    data = [(0, [1.0, 0.0]), (20, [1.0]), (20, [1.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, None), (80, [-1.0, 0.0]), (1, [0.5, 0.5])]
    got = searched(spark, data, "array<double>", recall=1.0)
    assert {i: [j for _, j, _ in near] for i, near in got.items()} == {0: [20, 1, 80], 20: [0, 1, 80], 80: [1, 0, 20]}
    assert searched(spark, [(0, [1.0])], "array<double>") == {} == searched(spark, [], "array<double>") == searched(spark, [(1, [1.0]), (2, [1.0])], "array<double>")
