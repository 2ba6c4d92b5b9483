import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import LOWER, same, words

from wayfarer.llm import anchors, common, components, simhash_dedup, substring_dedup, suffix_dedup


@pytest.mark.parametrize("window, gram", [(35, 5), (8, 3)])
def test_substring_dedup_equals_brute_force(docs, rows, window, gram):
    counts, want = Counter(), []
    for _, text in rows:
        w = words(text)
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 500
    same(substring_dedup.removed_repeats(docs, window, gram).collect(), want)


@pytest.mark.parametrize("length, gram", [(200, 32), (40, 16)])
def test_suffix_dedup_equals_brute_force(docs, rows, length, gram):
    counts, want = Counter(), []
    for _, text in rows:
        b = text.encode()
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 3000
    same(suffix_dedup.removed_repeats(docs, length, gram).collect(), want)


def test_merge_of_front_coded_runs_sorts_and_gives_common_prefixes():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(n)) for n in (40, 1, 33, 7, 60)]
    lcps = [[0] + [suffix_dedup.shared_from(a, b, 0) for a, b in zip(r, r[1:])] for r in runs]
    order, common = suffix_dedup.merge_runs(runs, lcps)
    out = [runs[r][k] for r, k in order]
    assert out == sorted(x for r in runs for x in r)
    assert common[1:] == [suffix_dedup.shared_from(a, b, 0) for a, b in zip(out, out[1:])]


def fingerprint(text):
    w = words(text.translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def grouped(rows, radius=3):
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            label[root(int(j))] = root(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].extend([d] if d is not None else [])
    return [(d, f"{int(fps[i]):016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def test_simhash_groups_equal_brute_force(docs, rows):
    same(simhash_dedup.near_duplicates(docs).collect(), grouped(rows))


def test_small_tiles_find_the_same_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)), base ^ np.uint64(7), np.array([0, 3, (1 << 64) - 1], np.uint64)]))
    near = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 3}
    want = {(int(a), int(b)) for a, b in zip(*components.forest(*(np.array(x, np.uint64) for x in zip(*near))))}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for tile in (2, 2048):
        got = components.stars(simhash_dedup.links(df, 3, tile), "t").collect()
        groups = lambda pairs: {frozenset(g) for g in by_root(pairs)}

        def by_root(pairs):
            out = defaultdict(set)
            for a, b in pairs:
                out[b] |= {a, b}
            return out.values()

        assert groups([(r.a % 2**64, r.b % 2**64) for r in got]) == groups(want)


def test_a_long_chain_is_one_component(spark):
    df = spark.range(199).selectExpr("id * 37 % 200 as a", "(id + 1) * 37 % 200 as b")
    assert {tuple(r) for r in components.stars(df, "chain").collect()} == {(k, 0) for k in range(1, 200)}


def test_one_row_of_each_group_stays_with_its_columns(docs, rows):
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x))
    assert ids == sorted({c for _, _, c in grouped(rows)}, key=lambda x: (x is not None, x))


def test_one_row_of_each_group_without_ids_stays(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in ("ash", "birch", "cedar")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (None, texts[2]), (None, None), (None, "")]
    assert all((fingerprint(a) ^ fingerprint(b)).bit_count() > 3 for a in [*texts, ""] for b in [*texts, ""] if a != b)
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(kept) == 4 and {(r.doc_id, r.text or "") for r in kept} == {(None, texts[0]), (None, texts[1]), (1, texts[2]), (None, "")}


def test_texts_whose_keys_agree_in_32_bits_keep_their_own_spans(spark):
    a, b = (" ".join(f"w{i}n{j}" for j in range(40)) for i in (23290, 231826))
    head, tail = " ".join(a.split()[:36]), " ".join(a.split()[36:])
    df = spark.createDataFrame([(None, a), (None, b), (1, head + " end")], "doc_id long, text string")
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (tail, b, "end")]
    got = {tuple(r) for r in substring_dedup.removed_repeats(df).collect()}
    assert got == {(None, 40, 36, sha[0]), (None, 40, 0, sha[1]), (1, 37, 36, sha[2])}
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.removed_repeats(df).collect()}
    n = len(head) + 1
    assert got == {(None, len(a), n, sha[0]), (None, len(b), 0, sha[1]), (1, n + 3, n, sha[2])}


def test_many_rows_without_ids_have_keys_of_their_own(spark):
    df = spark.range(400_000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    assert common.texts(df).selectExpr("count(distinct k1)", "count(distinct k2)", "count_if(k1 = k2)").first()[:] == (400_000, 400_000, 0)


@pytest.mark.parametrize("texts", [[None], [""], [" \n"], ["", ""], ["a " * 40] * 2, ["x" * 430] * 2, ["a " * 40, None]])
def test_tables_in_which_nothing_stays(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    empty = hashlib.sha256(b"").hexdigest()
    for r in substring_dedup.removed_repeats(df).collect():
        n = len(words(texts[r.doc_id]))
        assert tuple(r)[1:] == ((n, n, empty) if n >= 35 else (n, 0, hashlib.sha256(" ".join(words(texts[r.doc_id])).encode()).hexdigest()))
    left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.removed_repeats(df).collect()}
    assert left == {k: 0 if len(t or "") > 200 else len(t or "") for k, t in enumerate(texts)}


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out


def test_words_that_collide_in_polynomial_hashes_stay_apart(spark):
    one = thue_morse(2048)
    other = one.translate({97: "b", 98: "a"})
    rows = [(k, " ".join([f"w{j}" for j in range(20)] + [x] + [f"v{j}" for j in range(20)])) for k, x in enumerate((one, other))]
    got = substring_dedup.removed_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_settled_rows_are_dealt_over_all_buckets():
    rows = np.zeros(50_000, anchors.SPAN)
    rows["k2"] = np.arange(50_000)
    found = defaultdict(int)
    for which, part in anchors.dealt(rows, 64):
        found[which] += len(part)
    assert len(found) == 64 and max(found.values()) - min(found.values()) < 20_000 and sum(found.values()) == rows.nbytes


def test_seeds_found_part_by_part_are_those_of_the_whole(monkeypatch, docs, rows):
    rows = [r for r in rows if r[0] not in (300, 301)]  # a periodic text has those of one period for each part; test_periodic_texts has them
    batch = pa.record_batch({"text": [t for _, t in rows], "k1": np.arange(len(rows)), "k2": np.arange(len(rows))})

    def windows(of):
        return {(int(a["k1"]), int(a["pos"]) - o, int(a["pos"]), int(a["key"])) for a in of(batch) for o in range(a["lo"], a["hi"] + 1)}

    for module, make in ((substring_dedup, lambda: substring_dedup._seeds(35, 5)), (suffix_dedup, lambda: suffix_dedup._anchors(200, 32))):
        whole = windows(make())
        monkeypatch.setattr(module, "PART", 777)
        assert windows(make()) == whole and len(whole) > 5000


def test_empty_tables(none):
    for f in (substring_dedup.removed_repeats, suffix_dedup.removed_repeats, simhash_dedup.near_duplicates, simhash_dedup.one_of_each):
        assert f(none).count() == 0
