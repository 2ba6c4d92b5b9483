"""Experimental designs: uniform, Latin hypercube and maximin, and their diagnostics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.scalars import permuted, uniform
from wayfarer.operators import grid, kdtree
from wayfarer.sources.shared import stash

#: name, low, high, bins (0: continuous) of the numeric dimensions.
Dimension = tuple[str, float, float, int]


def draw(u: Column, low: float, high: float, discrete: bool = False, log: bool = False) -> Column:
    if discrete:
        return low + F.floor(u * (high - low + 1))
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low)))) if log else low + u * (high - low)


#: Points that one row stands for until they are made.
BLOCK = 1 << 16


def hypercubes(designs: DataFrame, numeric: list[Dimension], choices: dict[str, list[str]]) -> DataFrame:
    """design, id and one point in each of a design's n strata of each dimension, for each row (design, n, seed) of designs.

    The stratum of a point is its id's place in a permutation that seed and dimension draw, so points are made row by row, where
    their ids are, without any sort or exchange of points; blocks of ids are spread over the tasks.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long")))
    blocks = grid.spread(designs.where("n > 0").select("design", F.col("n").cast("long").alias("n"), "seed").select("*", starts.alias("start")))
    points = blocks.select("design", "n", "seed", F.explode(F.sequence("start", F.least(F.col("start") + BLOCK, F.col("n")) - 1)).alias("id"))
    names = [d[0] for d in numeric] + list(choices)
    # structs in an array of one, exploded, keep the optimizer from computing ranks anew wherever they are used
    ranks = [permuted(F.col("id"), F.col("n"), F.col("seed"), F.lit(name)).alias(name) for name in names]
    ranked = points.select("*", F.explode(F.array(F.struct(*ranks))).alias("k"))
    out = []
    for name, low, high, bins in numeric:
        u = (F.col(f"k.{name}") + uniform(F.col("seed"), F.lit("u"), F.lit(name), F.col("id"))) / F.col("n")
        out.append((low + F.least(F.floor(u * bins), F.lit(bins - 1)) if bins else low + u * (high - low)).cast("double").alias(name))
    out += [F.get(F.array(*map(F.lit, c)), F.col(f"k.{name}") % len(c)).alias(name) for name, c in choices.items()]
    return ranked.select("design", "id", *out)


def latin_hypercube(spark: SparkSession, n: int, seed: int, numeric: list[Dimension], choices: dict[str, list[str]]) -> DataFrame:
    """The points of one design."""
    return hypercubes(spark.range(1).select(F.lit(0).alias("design"), F.lit(n).alias("n"), F.lit(seed).alias("seed")), numeric, choices).drop("design")


def with_param(space: DataFrame, param: DataFrame) -> DataFrame:
    """The parameter space with one more parameter; a parameter of the same node and name is replaced."""
    return without_param(space, param.select("node", "name")).unionByName(param, allowMissingColumns=True)


def without_param(space: DataFrame, names: DataFrame) -> DataFrame:
    return space.join(names, ["node", "name"], "left_anti")


def unit(numeric: list[Dimension]) -> list[Column]:
    return [F.coalesce((F.col(name) - low) / F.nullif(F.lit(high - low), F.lit(0.0)), F.lit(0.0)).alias(f"u_{name}") for name, low, high, _ in numeric]


#: Candidates that a leaf sends at a time, and leaves for each point to take.
KEPT, LEAVES = 16, 8


class _Greedy:
    """Farthest-point selection in one category, from what its leaves have sent.

    Each leaf has candidates with their distance to the points taken, squared, and a bound for its other points: the
    least candidate's distance, or the farthest that its box is from a point taken since, if that is less. A candidate that no
    other and no bound exceeds is the farthest of all points; else the leaves with greater bounds are looked through again.
    """

    def __init__(self, want: int, first: tuple[int, np.ndarray], leaves: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.want, self.leaves, self.order = want, list(leaves), {k: i for i, k in enumerate(leaves)}
        self.low, self.high = (np.array([v[j] for v in leaves.values()]) for j in (0, 1))
        self.bound = np.full(len(leaves), np.inf)
        self.ids, self.of, self.gap, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, self.low.shape[1]))
        self.taken: list[tuple[int, np.ndarray]] = []
        self._take(*first)

    def _take(self, own: int, x: np.ndarray) -> None:
        self.taken.append((own, x))
        self.gap = np.minimum(self.gap, ((self.x - x) ** 2).sum(axis=1))
        self.bound = np.minimum(self.bound, (np.maximum(np.abs(x - self.low), np.abs(x - self.high)) ** 2).sum(axis=1))

    def sent(self, rows: list[tuple[int, int, float, np.ndarray]], asked: list[int]) -> None:
        """New candidates (leaf, id, gap, x) of the leaves that were asked, greatest gaps first."""
        again = np.array([self.order[k] for k in asked], np.int64)
        keep = ~np.isin(self.of, again)
        of = np.array([self.order[r[0]] for r in rows], np.int64)
        self.bound[again] = -1.0
        for k, r in zip(of.tolist(), rows, strict=True):
            self.bound[k] = r[2]  # the last is the least
        full = np.bincount(of, minlength=len(self.bound)) >= KEPT
        self.bound[again] = np.where(full[again], self.bound[again], -1.0)  # a leaf with fewer has sent all
        self.ids, self.of = np.r_[self.ids[keep], [r[1] for r in rows]].astype(np.int64), np.r_[self.of[keep], of]
        self.gap, self.x = np.r_[self.gap[keep], [r[2] for r in rows]], np.r_[self.x[keep], np.array([r[3] for r in rows]).reshape(-1, self.x.shape[1])]

    def blocked(self) -> list[int]:
        """Takes points as long as it is sure of them; the leaves to look through again, none at the end."""
        while len(self.taken) < self.want:
            open_ = ~np.isin(self.ids, [t[0] for t in self.taken])
            best = self.gap[open_].max(initial=-1.0)
            if (beyond := np.flatnonzero((self.bound >= max(best, 0.0)) & (self.bound > -1.0))).size:
                return [self.leaves[k] for k in beyond]
            if not open_.any():
                return []
            own = np.flatnonzero(open_ & (self.gap == best))
            k = own[np.argmin(self.ids[own])]
            self._take(int(self.ids[k]), self.x[k])
        return []


def quotas(pool: DataFrame, by: str, n: int) -> DataFrame:
    """by and n: how many rows of each category a balanced choice of n takes, no more than there are; only the categories meet in one task."""
    have = pool.groupBy(by).agg(F.count("*").alias("have"))
    place, kinds = F.row_number().over(Window.orderBy(by)), F.count("*").over(Window.partitionBy())
    share = F.floor(F.lit(n) / kinds) + (place <= F.lit(n) % kinds).cast("int")
    return have.select(by, F.least("have", share).alias("n"))


def maximin(pool: DataFrame, by: str, columns: list[str], n: int) -> DataFrame:
    """Per category its quota of pool rows, spread out: from the one nearest the centroid, always the farthest from those taken.

    pool: id (a number, unique), by and others. It is parted into leaves of a k-d tree, some for each point to take; the driver
    holds what they send (_Greedy), so its memory is bounded by the design, not by the pool, and a job looks only through
    leaves whose bound exceeds the best candidate. Ties go to the smaller id.
    """
    quota = {r[0]: r.n for r in quotas(pool, by, n).collect()}  # the values of a design's parameter
    kinds = list(quota)
    if not kinds:
        return pool
    at = F.array(*(F.col(c).cast("double") for c in columns)).alias("at")
    points = pool.select(F.col("id").cast("long").alias("id"), F.col(by).alias("kind"), at)
    sample = points.select("at").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, min(1 << 20, (kdtree.SAMPLE << 20) // max(1, points.count())))).limit(2 * kdtree.SAMPLE).collect()
    tree = kdtree.Tree.of(np.array([r[0] for r in sample], float).reshape(-1, len(columns)), max(1, (LEAVES * n // len(kinds)).bit_length() - 1))
    kind = pool.schema[by].dataType.simpleString()
    parted = stash(grid.spread(points).mapInArrow(kdtree._leaves(tree, len(columns)), f"leaf long, id long, kind {kind}, at array<double>"), "maximin-pool")
    cols = [F.col("at")[k] for k in range(len(columns))]
    boxes = parted.groupBy("kind", "leaf").agg(F.array(*map(F.min, cols)).alias("low"), F.array(*map(F.max, cols)).alias("high")).collect()
    middle = parted.groupBy("kind").agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)))
    far = sum((F.pow(c - F.col(f"m{k}"), 2) for k, c in enumerate(cols)), F.lit(0.0))
    firsts = {r.kind: (r.p.id, np.array(r.p["at"])) for r in parted.join(middle, "kind").groupBy("kind").agg(F.min(F.struct(far.alias("far"), "id", "at")).alias("p")).collect()}
    greedy = {c: _Greedy(quota[c], firsts[c], {r.leaf: (np.array(r.low), np.array(r.high)) for r in boxes if r.kind == c}) for c in kinds if quota[c]}
    while asked := {c: leaves for c, g in greedy.items() if (leaves := g.blocked())}:
        wanted = pool.sparkSession.createDataFrame([(c, k) for c, leaves in asked.items() for k in leaves], f"kind {kind}, leaf long")
        taken = {c: np.array([x for _, x in greedy[c].taken]) for c in asked}
        seen = parted.join(wanted, ["kind", "leaf"]).mapInPandas(_gaps(taken), f"kind {kind}, leaf long, id long, gap double, at array<double>")
        tops = seen.groupBy("kind", "leaf").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("gap")).alias("less"), "id", "at"))), 1, KEPT).alias("top"))
        sent: dict = {c: [] for c in asked}
        for r in tops.collect():
            sent[r.kind] += [(r.leaf, t.id, -t.less, np.array(t["at"])) for t in r.top]
        for c, leaves in asked.items():
            greedy[c].sent(sent[c], leaves)
    kept = pool.sparkSession.createDataFrame([(i,) for g in greedy.values() for i, _ in g.taken], "id long")
    return pool.join(kept, "id", "left_semi")


def _gaps(taken: dict) -> Callable:
    """Of each task's points the KEPT of each leaf that are farthest from the points taken, with that distance, squared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for c, own in rows.groupby("kind", sort=False):
                x, gap = np.stack(own["at"].to_list()), np.full(len(own), np.inf)
                for t in taken[c]:
                    gap = np.minimum(gap, ((x - t) ** 2).sum(axis=1))
                parts.append(own.assign(gap=gap).sort_values(["leaf", "gap", "id"], ascending=[True, False, True]).groupby("leaf", sort=False).head(KEPT))
            if parts:
                yield pd.concat(parts)[["kind", "leaf", "id", "gap", "at"]]

    return run


_TURNS = np.linspace(0, 2 * np.pi, 32, endpoint=False)
#: Groups of fewer points in a batch are sent on as they are.
FEW = 16


def _slack(pts: np.ndarray) -> float:
    """How near to a line a point may be so that doubles might not tell its side; thousands of times what rounding takes."""
    return 1e-10 * (1 + np.abs(pts).max(initial=0.0))


def _chains(rows: list[list[float]]) -> list[np.ndarray]:
    """The lower and the upper chain of rows in order, each with both ends."""
    out: list[np.ndarray] = []
    for points in (rows, rows[::-1]):
        chain: list[list[float]] = []
        for p in points:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                del chain[-1]
            chain.append(p)
        out.append(np.array(chain))
    return out


def _edge(pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points that a hull may need, by x and y: its corners and what may be on its edges; and the plain hull.

    Where points are on a line but for rounding, whether one is a corner depends on all of them, so none goes before all
    have met. A point between two others of the same x, or the same y, is no corner, however that is computed.
    """
    for last in (0, 1):
        pts = pts[np.lexsort((pts[:, last], pts[:, 1 - last]))]
        pts = pts[np.r_[True, (pts[1:] != pts[:-1]).any(axis=1)]] if last == 0 else pts
        same = pts[1:, 1 - last] == pts[:-1, 1 - last]
        pts = pts[~(np.r_[False, same] & np.r_[same, False])]
    slack = _slack(pts)
    if len(pts) > 64:  # those inside the polygon of the farthest points in some directions can't be on the hull
        far = pts[np.unique((pts @ np.array([np.cos(_TURNS), np.sin(_TURNS)])).argmax(axis=0))]
        far = far[np.argsort(np.arctan2(*(far - far.mean(axis=0)).T[::-1]))]
        side = np.roll(far, -1, axis=0) - far
        inside = np.logical_and.reduce([x * (pts[:, 1] - p[1]) - y * (pts[:, 0] - p[0]) > slack * (abs(x) + abs(y)) for p, (x, y) in zip(far, side, strict=True)])
        pts = pts[~inside] if len(far) > 2 else pts
    if len(pts) < 3:
        return pts, pts
    chains, near = _chains(pts.tolist()), np.zeros(len(pts), bool)
    for chain, way in zip(chains, (1, -1), strict=True):
        k = np.clip(np.searchsorted(way * chain[:, 0], way * pts[:, 0], side="right") - 1, 0, len(chain) - 2)
        (ax, ay), (dx, dy) = chain[k].T, (chain[k + 1] - chain[k]).T
        near |= dx * (pts[:, 1] - ay) - dy * (pts[:, 0] - ax) <= slack * (np.abs(dx) + np.abs(dy))
    return pts[near], np.concatenate([c[:-1] for c in chains])


def _ring(pts: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise from the least x; collinear points go.

    A corner is a point from which an edge leads to another, with all others on its left or on it, as doubles have it. If
    each point is clearly a corner or clearly inside, that is the plain hull. Otherwise each point takes for its edge's end
    the one that no other is to the right of, and that is compared with all.
    """
    pts, plain = _edge(pts) if len(pts) else (pts, pts)
    if len(pts) < 2:
        return pts
    if len(pts) == len(plain) > 2:
        to = np.roll(plain, -1, axis=0) - plain
        on = np.roll(to, -1, axis=0)
        if (to[:, 0] * on[:, 1] - to[:, 1] * on[:, 0] > _slack(pts) * (np.abs(to) + np.abs(on)).sum(axis=1)).all():
            return plain
    x, y = pts.T
    end = np.r_[1 : len(pts), 0]

    def holds(c: int) -> np.ndarray:
        """Of each point's edge, whether it may be one beside c."""
        bx, by, cx, cy = x[end] - x, y[end] - y, x[c] - x, y[c] - y
        left, right, along = bx * cy, by * cx, bx * cx + by * cy
        return (left > right) | ((left == right) & (along >= 0) & (along <= bx * bx + by * by))

    for c in range(len(pts)):
        end = np.where(holds(c), end, c)
    ring = pts[np.logical_and.reduce([holds(c) for c in range(len(pts))])]
    ring = ring[np.argsort(np.arctan2(*(ring - ring.mean(axis=0)).T[::-1]))] if len(ring) else ring
    return np.roll(ring, -np.lexsort(ring.T[::-1])[0], axis=0) if len(ring) else ring


def hull(points: DataFrame, by: str, single: bool = True) -> DataFrame:
    """Convex hull of each group's points (rounded to 6 digits), counter-clockwise from the least x; collinear points go.

    Tasks send what the hulls of their own points of each group may need, and a group's hull is that of those: it grows
    batch by batch, so no group is held whole, only its corners and what may be on its slanted edges. Points without a group
    or a coordinate are left out, without single also groups of one point.
    """

    def frame(rings: list[tuple[object, np.ndarray]]) -> pd.DataFrame:
        sizes = [len(r) for _, r in rings]
        xy = np.concatenate([np.empty((0, 2)), *(r for _, r in rings)])
        keys = pd.Series([k for k, _ in rings], dtype=object).repeat(sizes)
        return pd.DataFrame({by: keys.to_numpy(), "i": np.concatenate([np.arange(0), *map(np.arange, sizes)]), "x": xy[:, 0], "y": xy[:, 1]})

    def corners(edge: np.ndarray) -> np.ndarray:
        return _ring(edge if single or (edge != edge[0]).any() else edge[:0])

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xy = batch[["x", "y"]].to_numpy(float).round(6)
            yield frame([(key, xy[at] if len(at) < FEW else _edge(xy[at])[0]) for key, at in batch.groupby(by, sort=False).indices.items()])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, edge = None, np.empty((0, 2))
        for batch in batches:
            keys, xy, done = batch[by].to_numpy(), batch[["x", "y"]].to_numpy(float), []
            heads = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
                if len(edge) and keys[a] != now:
                    done.append((now, corners(edge)))
                    edge = np.empty((0, 2))
                now, edge = keys[a], _edge(np.concatenate([edge, xy[a:b]]))[0] if len(edge) else xy[a:b]
            yield frame(done)
        if len(edge):
            yield frame([(now, corners(edge))])

    ddl = f"`{by}` {points.schema[by].dataType.simpleString()}, i long, x double, y double"
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: groups go to all tasks
    rings = points.select(by, "x", "y").dropna().mapInPandas(own, ddl)
    return rings.repartition(n, by).sortWithinPartitions(by).mapInPandas(met, ddl)


def spread_out(spark: SparkSession, n: int, seed: int, numeric: list[Dimension], choices: dict[str, list[str]], oversample: int = 4) -> DataFrame:
    """A maximin design: n points kept of a Latin hypercube of oversample times as many, balanced by the first choice, in an order drawn by hash (column rank)."""
    pool = latin_hypercube(spark, n * oversample, seed, numeric, choices).select("*", *unit(numeric))
    kept = maximin(pool, next(iter(choices)), [f"u_{d[0]}" for d in numeric], n)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("id").cast("string"))), "id")) - 1)


TOO_FEW = 10


def valid_cells(cells: DataFrame, resolution: float, clearance: float, free: Column, occupied: Column, bounds: Column | None = None) -> DataFrame:
    """Cells (grid_id, row, col and others) where a robot may stand: free, within bounds, and far enough from all occupied ones."""
    far = grid.distances(cells.withColumn("occupied", occupied), resolution)
    good = free & (F.col("distance") >= clearance)
    return cells.join(far, ["grid_id", "row", "col"]).where(good & bounds if bounds is not None else good)


def pose_pairs(valid: DataFrame, n: int, seed: int, least: float = 3.0, most: float = 15.0, attempts: int = 1000, first: int = 16) -> DataFrame:
    """n pairs of start and goal (id, attempt, start, goal, distance) drawn from the cells (row, col, x, y) of one map.

    Each attempt draws two ranks of the numbered cells from hashes of seed, pair and attempt, so the result
    doesn't depend on partitions. Pairs that the first attempts don't settle go through all of them. The
    query fails if there are fewer than 10 cells, or if a pair has no attempt with a distance in range.
    """
    spark = valid.sparkSession
    cells = stash(grid.numbered(valid).select("rank", "x", "y"), "valid-cells")  # read for each end of each round
    count = cells.agg(F.count("*").alias("n")).select(F.when(F.col("n") < TOO_FEW, F.raise_error(F.concat(F.lit("too few valid cells: "), F.col("n").cast("string"))).cast("long")).otherwise(F.col("n")).alias("n"))

    def tried(pairs: DataFrame, low: int, high: int) -> DataFrame:
        each = pairs.select("id", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("attempt")).join(F.broadcast(count))  # one row
        ranks = each.select("id", "attempt", *(F.floor(uniform(F.lit(seed), F.lit(k), F.col("id"), F.col("attempt")) * F.col("n")).alias(k) for k in ("start", "goal")))
        for k in ("start", "goal"):
            ranks = ranks.join(cells.select(F.col("rank").alias(k), F.struct("x", "y").alias(f"{k}_at")), k)
        far = ranks.withColumn("distance", F.hypot(F.col("goal_at.x") - F.col("start_at.x"), F.col("goal_at.y") - F.col("start_at.y")))
        return far.where(F.col("distance").between(least, most)).groupBy("id").agg(F.min_by(F.struct("attempt", "start_at", "goal_at", "distance"), "attempt").alias("p"))

    every = spark.range(n)
    early = stash(tried(every, 1, min(first, attempts)), "pose-pairs")
    late = tried(every.join(early, "id", "left_anti"), first + 1, attempts) if attempts > first else early.limit(0)
    found = every.join(early.union(late), "id", "left")
    missing = F.raise_error(F.concat(F.lit(f"no start and goal {least} to {most} apart in {attempts} attempts, pair "), F.col("id").cast("string"))).cast("int")
    turn = lambda k: -math.pi + 2 * math.pi * uniform(F.lit(seed), F.lit(f"{k}_yaw"), F.col("id"), F.col("p.attempt"))
    pose = lambda k: F.struct(F.col(f"p.{k}_at.x").alias("x"), F.col(f"p.{k}_at.y").alias("y"), turn(k).alias("yaw")).alias(k)
    return found.select("id", F.when(F.col("p").isNull(), missing).otherwise(F.col("p.attempt")).alias("attempt"), pose("start"), pose("goal"), F.round("p.distance", 3).alias("distance"))
