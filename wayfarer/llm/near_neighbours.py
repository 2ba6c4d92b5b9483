"""Approximate nearest neighbours by largest inner product, from cross-polytope hash tables.

A fast Hadamard pseudo-rotation (random signs and a Hadamard transform, three times) turns a unit vector, and the
signed axis nearest to it is its hash. A bucket of a table is named by the hashes of some such functions, so many that it
holds some ROWS_A_BUCKET rows. Each vector is in one bucket of each table; a query probes in each table all
buckets whose axes are hardly worse than its own, by the sum of the squared differences along the functions. What
"hardly" means is fitted: a bounded sample of queries is compared with all vectors, and the limit is the one at which
the wanted share of their neighbours is met. Candidates are compared exactly, in double precision, on the original vectors.

Inner products become angles by one more coordinate: vectors are divided by the greatest length there is and the new
coordinate fills them up to length one, and queries have zero there.

Copies of a vector beyond the first k + 1 can't be anybody's neighbours and aren't put into tables; equal queries are
searched once. A bucket of more than PIECE rows is dealt in pieces, and its queries go to each of them. A query
is sent once to each group of buckets, whose vectors a task has in memory (GROUP_BYTES), and gets k rows of it, not pairs.

Defined cases: vectors that are null or zero or hold null or non-finite components, and rows without an id, take no
part; shorter vectors count as filled with zeros; rows that have the query's id aren't its neighbours, and repeated
rows count once; a query id with several vectors gets an answer for each; ties go to the smaller id; with too few
candidates all that were found are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import stash

ROWS_A_BUCKET, PIECE, GROUP_BYTES = 4096, 4096, 16 << 20
_PAIR_DDL = "k1 long, k2 long, id long, score double"


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Signs and a Hadamard transform, for each row of signs."""
    size = x.shape[1]
    for flip in signs:
        x, half = x * flip, 1
        while half < size:
            pair = x.reshape(len(x), -1, 2, half)
            x, half = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), size), 2 * half
        x = x / np.sqrt(size)
    return x


@dataclass
class Hashes:
    """tables x functions pseudo-rotations. dims: of the vectors; longest: the greatest length of them."""

    dims: int
    longest: float
    tables: int
    functions: int
    seed: int

    def __post_init__(self) -> None:
        self.axes = 1 << self.dims.bit_length()  # a coordinate more than dims at least
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.functions, 3, self.axes))

    def _filled(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        length = np.abs(x).max(axis=1, initial=0.0)[:, None]
        if query:
            out[:, : self.dims] = x / length
            return out / np.linalg.norm(out, axis=1, keepdims=True)
        out[:, : self.dims] = x / self.longest
        out[:, self.dims] = np.sqrt(np.maximum(0.0, 1.0 - np.square(out).sum(axis=1)))
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table, in columns."""
        full, out = self._filled(x, False), np.zeros((len(x), self.tables), np.int64)
        for t, functions in enumerate(self.signs):
            for signs in functions:
                z = rotated(full, signs)
                axis = np.abs(z).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * self.axes + axis + self.axes * (z[np.arange(len(z)), axis] < 0)
        return out + np.arange(self.tables) * (2 * self.axes) ** self.functions

    def worse(self, x: np.ndarray) -> np.ndarray:
        """For each query, table, function and signed axis the squared difference to the nearest axis."""
        full = self._filled(x, True)
        z = np.stack([np.stack([rotated(full, s) for s in functions], axis=1) for functions in self.signs], axis=1)
        both = np.concatenate([z, -z], axis=3)
        return np.square(both.max(axis=3, keepdims=True) - both)

    def needed(self, worse: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The limit at which one query meets each vector in one table at least."""
        within, out = codes - np.arange(self.tables) * (2 * self.axes) ** self.functions, np.zeros(codes.shape)
        for f in reversed(range(self.functions)):
            out += worse[np.arange(self.tables), f, within % (2 * self.axes)]
            within = within // (2 * self.axes)
        return out.min(axis=1)

    def probes(self, worse: np.ndarray, limit: float) -> np.ndarray:
        """All buckets that one query probes."""
        found = []
        for t, functions in enumerate(worse):
            codes, total = np.zeros(1, np.int64), np.zeros(1)
            for off in functions:
                near = np.flatnonzero(off <= limit)
                sums = total[:, None] + off[near]
                kept = sums <= limit
                codes, total = (codes[:, None] * 2 * self.axes + near)[kept], sums[kept]
            found.append(codes + t * (2 * self.axes) ** self.functions)
        return np.concatenate(found)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scored(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up the same way wherever it is done."""
    return (q * x).sum(axis=1)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k first by score, then id; the same id counts once."""
    order = np.lexsort((vec, -score, query))
    query, vec = query[order], vec[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])][: len(order)]
    order, query = order[fresh], query[fresh]
    heads = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(order)])
    return order[tn.run_of(np.diff(np.r_[heads, len(order)])) < k]


def _tops(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each row, and of those that are as good within rounding."""
    if scores.shape[1] <= k:
        rows, columns = np.indices(scores.shape)
        return rows.ravel(), columns.ravel()
    least = np.partition(scores, -k, axis=1)[:, -k]
    return np.nonzero(scores >= (least - 1e-9 * np.abs(scores).max(axis=1))[:, None])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v and the 128-bit key k1, k2 of v, without what takes no part."""
    v = F.col(vector)
    kind = df.schema[vector].dataType.elementType.simpleString()
    v = v if kind == "float" else v.cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return rows.where(finite & F.exists("v", lambda c: c != 0))


def _keyed(rows: DataFrame, dims: int) -> DataFrame:
    zero = F.lit(0.0).cast(rows.schema["v"].dataType.elementType)
    full = rows.withColumn("v", F.when(F.size("v") < dims, F.concat("v", F.array_repeat(zero, dims - F.size("v")))).otherwise(F.col("v")))
    return full.withColumns({"k1": F.xxhash64("v", F.lit(1)), "k2": F.xxhash64(F.lit(2), "v")})


def _near_sample(hashes: Hashes, ids: np.ndarray, vectors: np.ndarray, k: int) -> Callable:
    """Each sampled query's k nearest among a task's vectors, with the limit that finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worse = hashes.worse(vectors)
        query, vec, score, need = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for batch in batches:
            x, own = _matrix(batch.column("v"), hashes.dims), batch.column("id").to_numpy()
            s = vectors @ x.T
            s[ids[:, None] == own] = -np.inf
            i, j = _tops(s, k)
            i, j = i[np.isfinite(s[i, j])], j[np.isfinite(s[i, j])]
            exact = _scored(vectors[i], x[j])
            fit = np.zeros(len(i))
            codes = hashes.codes(x)
            for q in np.unique(i).tolist():
                fit[i == q] = hashes.needed(worse[q], codes[j[i == q]])
            query, vec, score, need = (np.r_[a, b] for a, b in ((query, i), (vec, own[j]), (score, exact), (need, fit)))
            kept = _best(query, vec, score, k)
            query, vec, score, need = query[kept], vec[kept], score[kept], need[kept]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (query, vec, score, need)], names=["query", "id", "score", "need"])

    return run


def fitted(vectors: DataFrame, queries: DataFrame, hashes: Hashes, k: int, recall: float, sample: int) -> float:
    """The limit at which this share of the neighbours of sample queries (those of the least hash) is met. It compares them with all vectors; sample x k rows a task are kept."""
    rows = queries.orderBy(F.xxhash64("id"), "k1", "k2").limit(sample).select("id", "v").collect()
    if not rows:
        return 0.0
    ids, own = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64).reshape(len(rows), hashes.dims)
    near = vectors.select("id", "v").mapInArrow(_near_sample(hashes, ids, own, k), "query long, id long, score double, need double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return float(first.agg(F.percentile("need", recall)).first()[0] or 0.0) + 1e-9


def _coded(hashes: Hashes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = hashes.codes(_matrix(batch.column("v"), hashes.dims))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * hashes.tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], names=["id", "v", "codes"])

    return run


def _probing(hashes: Hashes, limit: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                codes = [hashes.probes(w, limit) for w in hashes.worse(_matrix(part.column("v"), hashes.dims))]
                offsets = np.r_[0, np.cumsum([len(c) for c in codes])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes)))
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), lists], names=["k1", "k2", "codes"])

    return run


def _met(dims: int, k: int) -> Callable:
    """Of a group's vectors, which come first, in order of their cells, the k nearest of each query that comes behind them."""

    def answers(part: pa.RecordBatch, cells: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        q = _matrix(part.column("v"), dims)
        lists = part.column("cells")
        row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        want = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(want, kind="stable")
        row, want = row[order], want[order]
        heads = np.flatnonzero(np.r_[True, want[1:] != want[:-1]])
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ends = np.r_[heads[1:], len(want)]
        left, right = np.searchsorted(cells, want[heads]), np.searchsorted(cells, want[heads], "right")
        for h in np.flatnonzero(left < right).tolist():
            own, a, b = row[heads[h] : ends[h]], left[h], right[h]
            i, j = _tops(q[own] @ x[a:b].T, k)
            kept.append((own[i], a + j, _scored(q[own[i]], x[a + j])))
            if sum(len(c[0]) for c in kept) > 1 << 20:
                kept = [cut(kept, ids)]
        query, at, score = cut(kept, ids)
        return pa.RecordBatch.from_arrays([part.column("k1").take(pa.array(query)), part.column("k2").take(pa.array(query)), pa.array(ids[at]), pa.array(score)], names=["k1", "k2", "id", "score"])

    def cut(kept: list, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, at, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        best = _best(query, ids[at], score, k)
        return query[best], at[best], score[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            p, is_query = batch.column("p").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (is_query[1:] != is_query[:-1]), True]) if len(p) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if p[a] != group:
                    group, held, ready = p[a], [], None
                if not is_query[a]:
                    held.append((part.column("cell").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("v"), dims)))
                    ready = None
                elif held:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    for c in range(0, len(part), 1024):
                        yield answers(part.slice(c, 1024), *ready)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, recall: float = 0.95, tables: int = 4, sample: int = 256, key: str = "vec_id", vector: str = "embedding", seed: int = 1, functions: int | None = None) -> DataFrame:
    """query_id, rank, the neighbour under the name of key, and score: up to k nearest found of each row of queries among vectors.

    recall: the share of the sampled queries' neighbours that the limit is fitted to. functions: hash functions a table.
    """
    spark = vectors.sparkSession
    every, own = usable(vectors, key, vector), usable(queries, key, vector)
    most = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    length = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + F.pow(c / most, 2)))
    count, dims, longest = every.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    dims = max(dims or 1, own.agg(F.max(F.size("v"))).first()[0] or 1)
    every, own = _keyed(every, dims), _keyed(own, dims)
    if functions is None:
        functions = max(1, int(np.ceil(np.log(max(count, 1) / ROWS_A_BUCKET) / np.log(2 << dims.bit_length()))))
    hashes = Hashes(dims, longest or 1.0, tables, functions, seed)
    limit = fitted(every, own, hashes, k, recall, sample)

    by_vector = Window.partitionBy("k1", "k2").orderBy("id")
    firsts = every.dropDuplicates(["id", "k1", "k2"]).withColumn("copy", F.row_number().over(by_vector)).where(F.col("copy") <= k + 1)
    kind = every.schema["v"].dataType.simpleString()
    coded = stash(firsts.select("id", "v").mapInArrow(_coded(hashes), f"id long, v {kind}, codes array<long>"), "coded-vectors")
    full = coded.select(F.explode("codes").alias("code")).groupBy("code").count().where(F.col("count") > PIECE).select("code", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    groups = max(1, -(-count * tables * dims * 8 // GROUP_BYTES))  # not by partitions: each sends up to k + 1 rows a query
    pieces = F.coalesce("pieces", F.lit(1))
    cell = F.xxhash64("code", "piece")  # two cells that collide are compared together, no more
    group = F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int")

    placed = coded.withColumn("code", F.explode("codes")).join(full, "code", "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int"))
    sent = placed.withColumn("cell", cell).select(group.alias("p"), F.lit(False).alias("is_query"), "cell", "id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.array().cast("array<long>").alias("cells"), "v")
    distinct = own.dropDuplicates(["k1", "k2"]).select("k1", "k2", "v")
    probes = distinct.mapInArrow(_probing(hashes, limit), "k1 long, k2 long, codes array<long>")
    met = probes.select("k1", "k2", F.explode("codes").alias("code")).join(full, "code", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    wanted = met.withColumn("cell", cell).groupBy("k1", "k2", group.alias("p")).agg(F.collect_list("cell").alias("cells"))
    asked = wanted.join(distinct, ["k1", "k2"]).select("p", F.lit(True).alias("is_query"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("id"), "k1", "k2", "cells", "v")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.union(asked).repartition(tasks, "p").sortWithinPartitions("p", "is_query", "cell")
    found = dealt.mapInArrow(_met(dims, k + 1), _PAIR_DDL)
    best = found.repartition("k1", "k2").groupBy("k1", "k2", "id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id")
    best = best.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    each = own.select(F.col("id").alias("query_id"), "k1", "k2").distinct().join(best, ["k1", "k2"]).where("id != query_id")
    w = Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
