"""Content-defined anchors that occur again, found without sending any text.

An operator picks anchors in a text such that equal stretches of a given length have one at the same offset.
Tasks settle which of them recur among their own rows and send one of each kind by its hash; buckets see
which recur between tasks. A hash that two different anchors share only makes a candidate: the operators
compare the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn

#: lo and hi: how far before the anchor the last and the first of its stretches start.
ANCHOR = np.dtype([("key", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("pos", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("known", "u1")])
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("stop", "<i4")])
SPANS_DDL = "k1 long, k2 long, start int, stop int"
_AT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_AT_DDL = "k1 long, k2 long, pos int, lo int, hi int"
LEAST_DEALT = 256
#: lo of an entry that isn't an anchor but an end of a span, and hi of those that start one and that end one.
MARK, OPEN, CLOSE = 0xFFFF, 0xFFFF, 0xFFFE
MARK_KEY = 0x9E3779B97F4A7C15


def runs_of(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted column, and where it starts and ends."""
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def dealt(rows: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """Rows that need no bucket of their own, in parts over all n buckets by turns, so that none gets more than others."""
    size = max(LEAST_DEALT, -(-len(rows) // n))
    first = int(rows["k2"][0].view("u8") % np.uint64(n)) if len(rows) else 0
    for k, at in enumerate(range(0, len(rows), size)):
        yield (first + k) % n, rows[at : at + size].tobytes()


def periodic(pos: np.ndarray, key: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, gram: int, equal: Callable[[int, int, int], bool]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors to keep, and the periodic stretches (row, start, stop) that speak for the others.

    In a stretch of period p the anchor comes again every p units, as in a run of one letter at each byte. If a stretch has
    window + 2 p units, every window in it recurs p units before or after, so the whole stretch is known to be
    covered, and of anchors whose windows lie in it those of the first period stand for all. equal(start, stop, p): if the units
    from start to stop have period p.
    """
    keep, spans = np.ones(len(pos), bool), []
    gap = np.diff(pos)
    link = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    going = np.r_[False, link[1:] & link[:-1] & (gap[1:] == gap[:-1])][: len(link)]
    heads = np.flatnonzero(link & ~going)
    stops = np.flatnonzero(~going)
    ends = np.r_[stops, len(link)][np.searchsorted(stops, heads, "right")] if len(heads) else heads
    p = gap[heads]
    long = pos[ends] + gram - pos[heads] >= window + 2 * p
    for a, b, q in zip(heads[long].tolist(), ends[long].tolist(), p[long].tolist(), strict=True):
        start, stop = int(pos[a]), int(pos[b]) + gram
        if equal(start, stop, q):
            spans.append((int(row[a]), start, stop))
            own = slice(a, b + 1)
            keep[own] = (pos[own] - hi[own] < start + q) | (pos[own] - lo[own] + window > stop)
    return keep, spans


def marked(spans: list[tuple[int, int, int]], base: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Entries that open and close the union of spans in each row, of one key, so that all are told. base: the units before each row."""
    row, start, stop = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ([], [], [])))
    s, e = tn.merged(start + row, stop + row)  # one unit at each row's end keeps rows apart
    row = np.searchsorted(base + np.arange(len(base)), s, "right") - 1
    out = np.zeros(2 * len(s), ANCHOR)
    both = np.repeat(row, 2)
    out["key"], out["lo"], out["k1"], out["k2"] = MARK_KEY, MARK, k1[both], k2[both]
    out["pos"][0::2], out["pos"][1::2] = s - row - base[row], e - row - base[row]
    out["hi"][0::2], out["hi"][1::2] = OPEN, CLOSE
    return out


def told(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The anchors among a slice's entries, and the spans that the others open and close."""
    mark = found["lo"] == MARK
    ends = {x: found[x][mark] for x in ("row", "pos", "hi")}
    opens, closes = ends["hi"] == OPEN, ends["hi"] == CLOSE
    spans = np.zeros(int(opens.sum()), SPAN)
    for x in ("k1", "k2"):
        spans[x] = part.column(x).to_numpy()[ends["row"][opens]]
    spans["start"], spans["stop"] = ends["pos"][opens], ends["pos"][closes]
    return {x: v[~mark] for x, v in found.items()}, spans


def batch(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, schema.types, strict=True)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("told", pa.binary())])


def _blocks(of: Callable[[pa.RecordBatch], np.ndarray], n: int, at_once: int) -> Callable:
    def block(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        twice, first = tn.seen_twice(found["key"])
        found["known"] = twice
        told, found = found[twice], found[first]
        bucket = (found["key"] % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, bucket = found[order], bucket[order]
        for which, a, b in runs_of(bucket):
            yield batch((which, found[a:b].tobytes(), b""), _SENT)
        for which, part in dealt(told, n):
            yield batch((which, b"", part), _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            for part in tn.slices(rows, "text"):
                held.append(of(part))
                size += len(held[-1])
                if size >= at_once:
                    yield from block(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from block(np.concatenate(held))

    return run


def _recurring(group: pa.Table) -> pa.Table:
    found = np.frombuffer(b"".join(group.column("anchors").to_pylist()), ANCHOR)
    told = np.frombuffer(b"".join(group.column("told").to_pylist()), ANCHOR)
    twice, _ = tn.seen_twice(found["key"])
    both = np.concatenate([found[twice & (found["known"] == 0)], told])
    return pa.table([pa.array(both[x].astype(t.to_pandas_dtype())) for x, t in zip(_AT.names, _AT.types, strict=True)], schema=_AT)


def recurring(docs: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], n: int, at_once: int) -> DataFrame:
    """k1, k2 and the arrays pos, lo and hi of each row's anchors that occur again. of: a slice's anchors; n: buckets."""
    sent = docs.select("k1", "k2", "text").mapInArrow(_blocks(of, n, at_once), "bucket int, anchors binary, told binary")
    found = sent.groupBy("bucket").applyInArrow(_recurring, _AT_DDL)
    # repeated rows have all their anchors as often as there are rows
    per_row = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("pos", "lo", "hi"))).alias("at"))
    return per_row.select("k1", "k2", *(F.col(f"at.{x}").alias(x) for x in ("pos", "lo", "hi")))


def listed(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The anchors of a slice's rows, one after the other, with each one's row."""
    lists = {x: part.column(x) for x in ("pos", "lo", "hi")}
    counts = pa.compute.list_value_length(lists["pos"]).to_numpy(zero_copy_only=False).astype(np.int64)
    return {"row": np.repeat(np.arange(len(part)), counts)} | {x: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x, c in lists.items()}


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with its spans as arrays; a row's distinct spans are bounded by its own length, however often the row is repeated."""
    gathered = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return docs.join(gathered.select("k1", "k2", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), ["k1", "k2"], "left")


def covered(part: pa.RecordBatch, base: np.ndarray, total: int) -> np.ndarray:
    """If each unit of these rows is in a span; base: the units before each row."""
    steps = np.zeros(total + 1, np.int32)
    for name, by in (("starts", 1), ("stops", -1)):
        column = part.column(name)
        lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base[:-1], lengths)
        np.add.at(steps, at, by)
    return np.cumsum(steps[:-1]) > 0
