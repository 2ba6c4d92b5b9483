"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their four 16-bit blocks, and
each cell in tiles of bounded size. Fingerprints at distance r or less lie in cells whose counts differ
by r or less in sum, so all other tile pairs are skipped; the rest are compared whole, by exclusive-or
and bit counts. A task sends on a spanning forest of the links it found, not the links.

Defined cases: null text has no words and fingerprint zero, linked like any other; a null doc_id is kept
and joins its group, whose id is the least other doc_id (null if it has none); repeated rows share a
group; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import by_key, stash, texts
from wayfarer.llm.components import forest, stars

BLOCKS = 4  # there are 17 ** BLOCKS = 83,521 cells at most, which bounds what is broadcast
TILE = 2048
PART = 1 << 16


def _fingerprints(shingle: int, seed: int):
    def of(part: pa.RecordBatch) -> np.ndarray:
        data, at = tn.raw(part.column("text"))
        data = tn.LOWER[data]
        start, end, first = tn.words(data, at)
        text, start, end, _ = tn.respaced(data, at, start, end, first)
        counts = np.diff(first)
        n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
        head = np.repeat(first[:-1], n) + tn.run_of(n)
        tail = np.minimum(head + shingle, np.repeat(first[1:], n)) - 1
        digest, row = xxhash.xxh64_intdigest, np.repeat(np.arange(len(part)), n)
        ones = np.zeros((len(part), 64), np.int64)
        for a in range(0, len(head), PART):  # a long text's shingles part by part
            some = slice(a, a + PART)
            h = np.array([digest(text[x:y], seed) for x, y in zip(start[head[some]].tolist(), end[tail[some]].tolist(), strict=True)], np.uint64)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.r_[True, row[some][1:] != row[some][:-1]])
            ones[row[some][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        out = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text", 1 << 18):
                yield pa.RecordBatch.from_arrays([part.column(x) for x in ("doc_id", "k1", "k2")] + [pa.array(of(part).view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    return texts(docs).mapInArrow(_fingerprints(shingle, seed), "doc_id long, k1 long, k2 long, fp long")


def _links(radius: int):
    def near(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        if same:
            x, y = x[x < y], y[x < y]
        return a[x], b[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            (left, i), (right, j) = (tn_list(batch.column(x)) for x in ("left", "right"))
            same = batch.column("same").to_pylist()
            for k in range(len(batch)):
                x, y = near(left[i[k] : i[k + 1]], right[j[k] : j[k + 1]], same[k])
                if len(x):
                    held.append(forest(x, y))
            if held:
                a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def tn_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(lengths)]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at radius or less as their links do."""
    width, base = 64 // BLOCKS, 64 // BLOCKS + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1)) for k in range(BLOCKS)]
    placed = fps.select("fp", sum((c * base**k for k, c in enumerate(counts)), F.lit(0)).cast("int").alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("n"))
    cells = stash(cells, "simhash-cells")
    tiles = placed.join(F.broadcast(cells), "cell").withColumn("t", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    tiles = stash(tiles.groupBy("cell", "t").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius and d >= (0,) * BLOCKS]
    digits = [F.floor(F.col("cell") / base**k).cast("int") % base for k in range(BLOCKS)]
    moves = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in steps)))
    around = cells.select("cell", "n", *(x.alias(f"p{k}") for k, x in enumerate(digits)), moves.alias("d"))
    inside = [(F.col(f"p{k}") + F.col(f"d.d{k}")) for k in range(BLOCKS)]
    for x in inside:
        around = around.where(x.between(0, width))
    around = around.select("cell", "n", sum((x * base**k for k, x in enumerate(inside)), F.lit(0)).cast("int").alias("other"))
    pairs = around.join(F.broadcast(cells.select(F.col("cell").alias("other"), F.col("n").alias("m"))), "other")
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.where("cell <> other or t <= u").select("cell", "t", "other", "u", F.expr("cell = other and t = u").alias("same"))
    left = pairs.join(tiles.withColumnRenamed("fps", "left"), ["cell", "t"])
    both = left.join(tiles.select(F.col("cell").alias("other"), F.col("t").alias("u"), F.col("fps").alias("right")), ["other", "u"])
    return both.select("left", "right", "same").mapInArrow(_links(radius), "a long, b long")


def groups(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, k1, k2, fp, root and component_id of every row; root is a fingerprint that names the group, also one without ids."""
    rows = stash(fingerprints(docs, shingle, seed), "simhash-rows")
    kinds = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-kinds")
    root = stars(links(kinds.select("fp"), radius), "simhash")
    kinds = kinds.join(root.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = kinds.groupBy("root").agg(F.min("id").alias("component_id"))
    of = kinds.join(least, "root").select("fp", "root", "component_id")
    return rows.join(of, "fp")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    return groups(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs without all but one row of each group: the one of the least doc_id, and of rows of one id the first by text hash."""
    keep = groups(docs, radius).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    keep = keep.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    return by_key(docs, keep, "left_semi", once=True)
