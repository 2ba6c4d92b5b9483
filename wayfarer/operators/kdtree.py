"""Exact nearest neighbours in any number of dimensions, by a k-d tree over a bounded sample.

The sample's medians split all dimensions in turn, so leaves hold about as many obstacles each, however these crowd. A point is first
compared with its own leaf. The distance found bounds the search: it goes on to the leaves whose box is nearer, and to no
other. A task has one leaf in memory. Leaves that many points meet are dealt in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.grid import spread
from wayfarer.sources.shared import stash

SAMPLE, LEAF, MOST_LEAVES, PIECE, AT_ONCE = 1 << 17, 256, 1 << 16, 100_000, 1 << 21


@dataclass
class Tree:
    """Splits in the order of a heap: node k has the children 2k and 2k + 1; leaves follow the last splits."""

    depth: int
    dim: np.ndarray
    value: np.ndarray
    low: np.ndarray  # boxes of all nodes
    high: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Tree:
        dims = sample.shape[1]
        dim, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        low, high = np.full((2 << depth, dims), -np.inf), np.full((2 << depth, dims), np.inf)
        rows = {1: sample}
        for k in range(1, 1 << depth):
            own = rows.pop(k)
            dim[k] = int(np.argmax(np.ptp(own, axis=0))) if len(own) else k.bit_length() % dims
            x = own[:, dim[k]]
            value[k] = np.median(x) if len(x) else 0.0
            for child, part in ((2 * k, own[x < value[k]]), (2 * k + 1, own[x >= value[k]])):
                low[child], high[child], rows[child] = low[k], high[k], part
            high[2 * k, dim[k]], low[2 * k + 1, dim[k]] = value[k], value[k]
        return Tree(depth, dim, value, low, high)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + (x[rows, self.dim[at]] >= self.value[at])
        return at

    def within(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point and each leaf whose box is nearer to it than the square root of squares."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            off = np.maximum(0.0, np.maximum(self.low[node] - x[row], x[row] - self.high[node]))
            near = np.square(off).sum(axis=1) < squares[row]
            row, node = row[near], node[near]
        return row, node


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("at").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _leaves(tree: Tree, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_matrix(batch, dims))), *batch.columns], names=["leaf", *batch.schema.names])

    return run


def _others(tree: Tree, dims: int) -> Callable:
    """The leaves that may have something nearer than what a point's own leaf had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 4096):
                batch = whole.slice(k, 4096)
                x = _matrix(batch, dims)
                row, leaf = tree.within(x, batch.column("squares").to_numpy(zero_copy_only=False))
                other = leaf != batch.column("leaf").to_numpy()[row]
                row, leaf = row[other], leaf[other]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c).take(pa.array(row)) for c in ("id", "at"))], names=["leaf", "id", "at"])

    return run


def _compared(dims: int, but_itself: bool) -> Callable:
    """Each point's least squared distance to its leaf's obstacles, which come first, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            leaf, asks = batch.column("leaf").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            piece = batch.column("piece").to_numpy()
            edges = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1]), True]) if len(leaf) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if (leaf[a], piece[a]) != now:
                    now, held = (leaf[a], piece[a]), []
                if not asks[a]:
                    held.append((_matrix(part, dims), part.column("id")))
                    continue
                theirs = np.concatenate([np.empty((0, dims)), *(x for x, _ in held)])
                ids = pa.concat_arrays([i for _, i in held]) if held else part.column("id").slice(0, 0)
                x, best = _matrix(part, dims), np.full(len(part), np.inf)
                known = pc.index_in(part.column("id"), value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False) if but_itself and len(ids) else np.full(len(part), -1)
                step = max(1, AT_ONCE // max(1, len(theirs) * dims))
                for k in range(0, len(part) if len(theirs) else 0, step):
                    d = np.square(x[k : k + step, None] - theirs[None]).sum(axis=2)
                    own = np.flatnonzero(known[k : k + step] >= 0)
                    d[own, known[k : k + step][own]] = np.inf
                    best[k : k + step] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best), pa.array(np.full(len(part), len(theirs)))], names=["id", "squares", "compared"])

    return run


def nearest(points: DataFrame, obstacles: DataFrame, dims: tuple[str, ...], but_itself: bool = False) -> DataFrame:
    """id, distance from each point (id and dims) to the nearest obstacle (dims), +inf without obstacles, and compared, the obstacles it was compared with.

    but_itself: obstacles have ids too, and a point's own id doesn't count. Obstacles at one place count as one (with
    but_itself, points that share their place with another id are at distance 0). Points with a null or NaN have distance +inf.
    """
    spark = points.sparkSession
    fit = lambda df: F.forall(F.array(*dims), lambda c: c.isNotNull() & ~F.isnan(c))
    at: Column = F.array(*(F.col(c).cast("double") for c in dims)).alias("at")
    every = points.select("id", at, fit(points).alias("fit"))
    kind = points.schema["id"].dataType.simpleString()
    them = obstacles.where(fit(obstacles)).select(*(["id"] if but_itself else []), at)
    if but_itself:  # of ids at one place one stands for all; a place of several is at distance 0 from itself
        places = stash(them.groupBy("at").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("several")), "places")
    else:
        places = stash(them.distinct().select("at", F.lit(None).cast(kind).alias("id"), F.lit(False).alias("several")), "places")
    count = places.count()
    if not count:
        return points.select("id", F.lit(float("inf")).alias("distance"), F.lit(0).cast("long").alias("compared"))
    depth = max(1, min(MOST_LEAVES, -(-count // LEAF)).bit_length() - 1)
    sample = places.select("at").where(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // count))).limit(2 * SAMPLE).collect()
    tree = Tree.of(np.array([r[0] for r in sample], float).reshape(-1, len(dims)), depth)

    theirs = spread(places.select("id", "at")).mapInArrow(_leaves(tree, len(dims)), f"leaf long, id {kind}, at array<double>")
    first = stash(spread(every.where("fit").select("id", "at")).mapInArrow(_leaves(tree, len(dims)), f"leaf long, id {kind}, at array<double>"), "own-leaf")

    def met(asking: DataFrame) -> DataFrame:
        """Least squares and compared of asking (leaf, id, at), by id."""
        crowded = asking.groupBy("leaf").count().where(F.col("count") > PIECE).select("leaf", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
        pieces = F.coalesce("pieces", F.lit(1))
        mine = asking.join(crowded, "leaf", "left").select("leaf", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"), F.lit(True).alias("asks"), "id", "at")
        given = theirs.join(crowded, "leaf", "left").select("leaf", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(False).alias("asks"), "id", "at")
        dealt = spread(mine.union(given), "leaf", "piece").sortWithinPartitions("leaf", "piece", "asks")
        return dealt.mapInArrow(_compared(len(dims), but_itself), f"id {kind}, squares double, compared long")

    own = stash(met(first), "nearest")
    left = first.join(own.groupBy("id").agg(F.min("squares").alias("squares")), "id")
    rest = stash(left.mapInArrow(_others(tree, len(dims)), f"leaf long, id {kind}, at array<double>"), "other-leaves")
    best = own.union(met(rest)).groupBy("id").agg(F.min("squares").alias("squares"), F.sum("compared").alias("compared"))
    out = every.join(best, "id", "left")
    if but_itself:
        shared = places.where("several").select("at", F.lit(True).alias("shared"))
        out = out.join(shared, "at", "left").withColumn("squares", F.when(F.col("shared"), 0.0).otherwise(F.col("squares")))
    return out.select("id", F.coalesce(F.sqrt("squares"), F.lit(float("inf"))).alias("distance"), F.coalesce("compared", F.lit(0)).alias("compared"))
