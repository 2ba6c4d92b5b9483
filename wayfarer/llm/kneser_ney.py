"""LM scoring with an interpolated modified Kneser-Ney n-gram model.

Spark counts the n-grams: tasks count their own and send sorted blocks by bucket of the context, buckets sum
them, and hand the continuation counts on to the next lower order in the same way. Each bucket writes its
counts as hash arrays in sorted order to the shared folder. The n-grams of a hot context, as the word before a
third of all words, are dealt to buckets one by one, and its statistics summed. Workers map those files into memory, so that
the model takes page cache, not heap, and look n-grams up by binary search.

A document is its lower-cased words and one end token, with start tokens as the first contexts. Discounts
come from the counts of counts of each order; the unigrams are interpolated with the uniform distribution
over the training vocabulary and one unknown token. Words and n-grams are told by 64-bit hashes and never
compared, as is usual for such models: two that collide (some 1e-5 of a chance among 1e7 n-grams) share a count.

Defined cases: null text is empty and has the end token only; a null doc_id counts as held out; repeated
rows count each; without training rows all probability is the unknown token's; an empty table gives an
empty result; further columns are ignored. A shard that is missing raises an error.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import buckets, posix_path, shared_dir, texts

START, STOP = np.uint64(0x51A27), np.uint64(0x0E4D)
_BLOBS = ("ctx", "run", "chain", "word", "count", "raw")
_DDL = "bucket int, " + ", ".join(f"{x} binary" for x in _BLOBS)
_SCHEMA = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in _BLOBS)])
STATS = ("total", "one", "two", "more")
#: A context with 1/(SHARE n) of all tokens is hot, n being the number of buckets.
SHARE = 4
#: Shards that a worker keeps mapped at most.
MAPS = 16_384
_HEAD = 11  # contexts, keys, n1, n2, n3, n4, raw tokens; sums over the contexts of total, one, two and more


def grams(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tn.mix(ctx * tn.BASE ^ tn.mix(word))


def dealt_by(level: int, ctx: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What n-grams of a level are dealt to buckets by: unigrams by word, others by context, those of a hot context one by one."""
    if level == 1:
        return word
    return np.where(_found(hot, ctx)[1], grams(ctx, word), ctx) if len(hot) else ctx


def _small(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.astype("<u4").tobytes())


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4").astype(np.int64)


@dataclass
class Counts:
    """N-grams: contexts with their shorter contexts in columns, words, counts, and occurrences in the text."""

    ctx: np.ndarray
    chain: np.ndarray
    word: np.ndarray
    count: np.ndarray
    raw: np.ndarray

    def summed(self) -> Counts:
        key = grams(self.ctx, self.word)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]) if len(key) else np.zeros(0, np.int64)
        first = order[heads]
        sums = [np.add.reduceat(x[order], heads) if len(heads) else x for x in (self.count, self.raw)]
        return Counts(self.ctx[first], self.chain[first], self.word[first], *sums)

    def rows(self, n: int, level: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (dealt_by(level, self.ctx, self.word, hot) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((self.ctx, bucket))
        bucket = bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            ctx = self.ctx[at]
            heads = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
            run = np.diff(np.r_[heads, len(ctx)])
            raw = b"" if np.array_equal(self.raw[at], self.count[at]) else _small(self.raw[at])
            values = (int(bucket[a]), ctx[heads].tobytes(), _small(run), self.chain[at[heads]].tobytes(), self.word[at].tobytes(), _small(self.count[at]), raw)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    @staticmethod
    def read(table: pa.Table, depth: int) -> Counts:
        parts = []
        for ctx, run, chain, word, count, raw in zip(*(table.column(x).to_pylist() for x in _BLOBS), strict=True):
            run, count = _large(run), _large(count)
            ctx = np.repeat(np.frombuffer(ctx, "<u8"), run)
            chain = np.repeat(np.frombuffer(chain, "<u8").reshape(len(run), depth), run, axis=0)
            parts.append((ctx, chain, np.frombuffer(word, "<u8"), count, _large(raw) if raw else count))
        return Counts(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def tokens(part: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with each row's end token, contexts of order - 1 words and less in columns, and tokens of each row."""
    data, at = tn.raw(part.column("text"))
    data = tn.LOWER[data]
    start, end, first = tn.words(data, at)
    h = tn.hashes(data, start, end)
    n, pad = np.diff(first), order - 1
    row = np.repeat(np.arange(len(part)), n)
    stream = np.full(len(h) + len(part) * (pad + 1), START)
    stream[np.arange(len(h)) + row * (pad + 1) + pad] = h
    stops = first[1:] + np.arange(len(part)) * (pad + 1) + pad
    stream[stops] = STOP
    scored = np.sort(np.concatenate([np.arange(len(h)) + row * (pad + 1) + pad, stops]), kind="stable")
    columns, last = [], np.zeros(len(stream), np.uint64)
    for _ in range(pad):  # last[i]: hash of the words before i, one more each round
        last = np.r_[np.uint64(0), tn.mix(stream[:-1] + tn.BASE * last[:-1])]
        columns.append(last[scored])
    return stream[scored], np.stack(columns[::-1], axis=1), n + 1


def _heavy(order: int, n: int, at_once: int) -> Callable:
    """The tokens of each block (level 0), and the contexts with a fair share of them by level."""

    def block(contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [(0, 0, len(contexts))]
        for level in range(2, order + 1):
            ctx, count = np.unique(contexts[:, order - level], return_counts=True)
            often = count * SHARE * n >= len(contexts)
            found += [(level, c, k) for c, k in zip(ctx[often].view(np.int64).tolist(), count[often].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["level", "ctx", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in tn.slices(batch, "text"):
                held.append(tokens(part, order)[1])
                size += len(held[-1])
                if size >= at_once:
                    yield from block(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from block(np.concatenate(held))

    return run


def hot_contexts(docs: DataFrame, order: int, n: int, at_once: int) -> list[np.ndarray]:
    """By level, the sorted contexts that hold 1/(SHARE n) of all tokens or more: SHARE n a level at most, so few come to the driver.

    It only says how n-grams are dealt: any list gives the same model.
    """
    seen = docs.select("text").mapInArrow(_heavy(order, n, at_once), "level long, ctx long, count long")
    top = seen.groupBy("level", "ctx").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "level", "ctx").limit(1 + (order - 1) * SHARE * n).collect()
    total = sum(r["count"] for r in top if r.level == 0)
    return [np.sort(np.array([r.ctx for r in top if r.level == level and r["count"] * SHARE * n >= total], np.int64).view(np.uint64)) for level in range(order + 1)]


def _counted(order: int, n: int, at_once: int, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> Iterator[pa.RecordBatch]:
            word, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            one = np.ones(len(word), np.int64)
            yield from Counts(ctx[:, 0], ctx[:, 1:], word, one, one).summed().rows(n, order, hot)

        for batch in batches:
            for part in tn.slices(batch, "text"):
                held.append(tokens(part, order)[:2])
                size += len(held[-1][0])
                if size >= at_once:
                    yield from block()
                    held, size = [], 0
        if held:
            yield from block()

    return run


def _settled(path: str, level: int, n: int, hot: list[np.ndarray]) -> Callable:
    """Sums a bucket, writes its sorted arrays and hands on the continuation counts."""

    def run(group: pa.Table) -> pa.Table:
        c = Counts.read(group, level - 2 if level > 1 else 0).summed()
        which = group.column("bucket")[0].as_py()
        order = np.argsort(c.ctx, kind="stable")
        ctx = c.ctx[order]
        heads = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        sums = [np.add.reduceat(x[order], heads) for x in (c.count, c.count == 1, c.count == 2, c.count > 2)]
        few = [int((c.count == k).sum()) for k in (1, 2, 3, 4)]
        file = f"{path}/{level}-{which}"
        own = f"{path}/.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            np.array([len(heads), len(c.word), *few, int(c.raw.sum()), *(int(x.sum()) for x in sums)], "<u8").tofile(out)
            for x in (ctx[heads], *sums, grams(c.ctx, c.word), c.count, c.raw if level == 1 else c.raw[:0]):
                x.astype("<u8" if x.dtype == np.uint64 else "<u4").tofile(out)
                out.write(b"\0" * (-out.tell() % 8))
        os.replace(own, file)  # a task that runs again replaces its own file
        if level == 1:
            return pa.table([pa.array([which], pa.int32()), *[pa.array([b""])] * len(_BLOBS)], schema=_SCHEMA)
        lower = c.chain[:, 0] if level > 2 else np.zeros(len(c.word), np.uint64)
        below = Counts(lower, c.chain[:, 1:], c.word, np.ones(len(c.word), np.int64), c.raw).summed()
        return pa.Table.from_batches(list(below.rows(n, level - 1, hot[level - 1])), _SCHEMA)

    return run


class Shard:
    """One file of sorted arrays: one map, which keeps no descriptor, and views of it."""

    def __init__(self, file: str, level: int) -> None:
        with open(file, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        head = np.frombuffer(whole, "<u8", _HEAD)
        n, m, at = int(head[0]), int(head[1]), _HEAD * 8
        kinds = [("ctx", "<u8", n), *((x, "<u4", n) for x in STATS), ("key", "<u8", m), ("count", "<u4", m), ("raw", "<u4", m if level == 1 else 0)]
        for name, kind, size in kinds:
            setattr(self, name, np.frombuffer(whole, kind, size, at) if size else np.zeros(0, kind))
            at += -(-np.dtype(kind).itemsize * size // 8) * 8


@lru_cache(maxsize=MAPS)
def shard(path: str, level: int, k: int) -> Shard:
    """A shard, mapped when it is first looked at; one that is missing raises."""
    return Shard(f"{path}/{level}-{k}", level)


def _found(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, queries), max(len(keys) - 1, 0))
    return at, keys[at] == queries if len(keys) else np.zeros(len(queries), bool)


@dataclass
class Model:
    path: str
    order: int
    n: int
    discounts: list[tuple[float, float, float]]  # by level
    total: int  # continuation counts of all unigrams
    spread: float  # what the unigrams leave to the uniform distribution
    kinds: int
    train_tokens: int
    listed: tuple[bytes, ...]  # which shards there are
    hot: list[np.ndarray]  # by level, contexts whose n-grams are dealt one by one
    hot_stats: list[np.ndarray]  # by level, their total, one, two and more over all shards in rows

    def _look(self, level: int, by: np.ndarray, keys: np.ndarray, ctx: bool, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values of keys in the shards that by selects; 0 where a key isn't there."""
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        keys, bucket = keys[first], (by[first] % np.uint64(self.n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n + 1))
        out = [np.zeros(len(keys), np.int64) for _ in names]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if self.listed[level - 1][k]:
                own, at = shard(self.path, level, k), order[edges[k] : edges[k + 1]]
                place, hit = _found(own.ctx if ctx else own.key, keys[at])
                for x, name in zip(out, names, strict=True):
                    x[at[hit]] = getattr(own, name)[place[hit]]
        return [x[back] for x in out]

    def scores(self, word: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of each token. ctx: the longest context in the first column."""
        root = np.zeros(len(word), np.uint64)
        count, raw = self._look(1, word, grams(root, word), False, ("count", "raw"))
        p = np.full(len(word), 1.0 / (self.kinds + 1))
        if self.total:
            p = (count - self._less(1, count)) / self.total + self.spread * p
        for level in range(2, self.order + 1):
            here = np.ascontiguousarray(ctx[:, self.order - level])
            count, = self._look(level, dealt_by(level, here, word, self.hot[level]), grams(here, word), False, ("count",))
            stats = np.stack(self._look(level, here, here, True, STATS))
            if len(self.hot[level]):
                at, hot = _found(self.hot[level], here)
                stats[:, hot] = self.hot_stats[level][:, at[hot]]
            total, one, two, more = stats
            d = self.discounts[level - 1]
            seen = np.maximum(total, 1)
            p = np.where(total > 0, (count - self._less(level, count)) / seen + (d[0] * one + d[1] * two + d[2] * more) / seen * p, p)
        return np.log10(p), raw

    def _less(self, level: int, count: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[level - 1]])[np.minimum(count, 3)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more; half the count where the counts of counts don't tell."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _read(path: str, listed: tuple[bytes, ...], hot: list[np.ndarray]) -> Callable:
    """Of some shards' files, by level: the sums of their heads (no ctx), and of the statistics of each hot context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, list[int]] = {}
        stats = [np.zeros((len(x), len(STATS)), np.int64) for x in hot]
        for batch in batches:
            for level, k in zip(batch.column("level").to_pylist(), batch.column("k").to_pylist(), strict=True):
                if not listed[level - 1][k]:
                    continue
                found = np.fromfile(f"{path}/{level}-{k}", "<u8", _HEAD).tolist()
                heads[level] = [a + b for a, b in zip(heads.get(level, [0] * _HEAD), found, strict=True)]
                if len(hot[level]):
                    own = Shard(f"{path}/{level}-{k}", level)
                    at, hit = _found(own.ctx, hot[level])
                    for j, name in enumerate(STATS):
                        stats[level][hit, j] += getattr(own, name)[at[hit]]
        rows = [(level, None, sums) for level, sums in heads.items()]
        rows += [(level, k, row) for level, x in enumerate(stats) for k, row in enumerate(x.tolist()) if any(row)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["level", "ctx", "sums"])

    return run


def read_back(spark: SparkSession, path: str, listed: tuple[bytes, ...], hot: list[np.ndarray]) -> tuple[list[list[int]], list[np.ndarray]]:
    """The sums of all heads by level, and the hot contexts' statistics in rows, read in tasks and summed by Spark."""
    n = len(listed[0])
    every = spark.range(n * len(listed)).selectExpr(f"id div {n} + 1 as level", f"id % {n} as k")
    sums = every.mapInArrow(_read(path, listed, hot), "level long, ctx long, sums array<long>").select("level", "ctx", *(F.get("sums", k).alias(f"s{k}") for k in range(_HEAD)))
    heads, stats = [[0] * _HEAD for _ in listed], [np.zeros((len(STATS), len(x)), np.int64) for x in hot]
    for r in sums.groupBy("level", "ctx").agg(*(F.sum(f"s{k}") for k in range(_HEAD))).collect():  # rows by level and hot context
        if r.ctx is None:
            heads[r.level - 1] = list(r)[2:]
        else:
            stats[r.level][:, r.ctx] = list(r)[2 : 2 + len(STATS)]
    return heads, stats


def train(docs: DataFrame, order: int = 2, at_once: int = 2_000_000) -> Model:
    """Counts all rows of docs (as texts() gives them) and writes the model to the shared folder."""
    spark = docs.sparkSession
    n = buckets(docs, 1)
    uri = shared_dir(spark, "kneser-ney")
    path = posix_path(uri)
    os.makedirs(path)
    hot = hot_contexts(docs, order, n, at_once)
    rows = docs.select("text").mapInArrow(_counted(order, n, at_once, hot[order]), _DDL)
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(_settled(path, level, n, hot), _DDL)
    rows.write.format("noop").mode("overwrite").save()
    there = set(os.listdir(path))
    listed = tuple(bytes(f"{level}-{k}" in there for k in range(n)) for level in range(1, order + 1))
    heads, hot_stats = read_back(spark, path, listed, hot)
    if len({int(h[6]) for h in heads}) > 1:  # every level holds each training token once
        raise OSError(f"the levels of the model in {path} hold different numbers of tokens: a shard is missing")
    ones = [d for d in (discounts(*map(int, h[2:6])) for h in heads)]
    few = [int(x) for x in heads[0][7:]]
    spread = sum(d * c for d, c in zip(ones[0], few[1:], strict=True)) / few[0] if few[0] else 1.0
    return Model(path, order, n, ones, few[0], spread, int(heads[0][1]), int(heads[0][6]), listed, hot, hot_stats)


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.train_tokens + 0.1 * (model.kinds + 1)
        for batch in batches:
            for part in tn.slices(batch, "text", 2 << 20):
                word, ctx, n = tokens(part, model.order)
                score, raw = model.scores(word, ctx)
                heads = np.cumsum(n) - n
                sums = [np.add.reduceat(x, heads) for x in (raw > 0, np.log10((raw + 0.1) / floor), score)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), model.train_tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Per document: its base score and the model's, learned from the rows that aren't held out."""
    rows = texts(docs).withColumn("held_out", held_out()).select("doc_id", "text", "held_out")
    model = train(rows.where("not held_out"), order)
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
