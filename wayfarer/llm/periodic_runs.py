"""Runs of words that repeat with a period, found by Crochemore's partition refinement.

Positions of a text are in one class if the same factor (stretch of words) of a length starts at them. Classes of
length p + 1 come from those of length p by moving out the positions before each class that isn't the largest part
of its former class: a position moves log n times at most. A class's neighbouring members that lie p apart start a
square of period p, and squares that start one after the other are one run. A run of LEAST words or more holds equal
factors of FACTOR words at its period's distance, so the first partition is by factors of that length, made
by sorting for all texts of a slice at once, and only texts in which such factors recur are refined. Refinement ends when
the gaps of all classes are at most half the length: such a class lies in one run and loses members from its end only.

Words are told by Arrow's dictionary of the slice's words, and a hash only leaves out positions whose factors don't
recur; equal factors are found by their words.

Defined cases: null text has no words; texts are taken row by row, so repeated rows, ties and null ids are nothing
special; a text of any length is taken whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn

LEAST, FACTOR = 12, 6
SLICE = 4 << 20
_RUN = "array<struct<start:long,length:long,period:long>>"
_DDL = f"doc_id long, n_words long, runs {_RUN}, collapsed string"


def _first_classes(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose factor of FACTOR words recurs in their text, and their classes by FACTOR and by FACTOR + 1 words."""
    n = np.diff(first)
    row, room = np.repeat(np.arange(len(n)), n), np.repeat(first[1:], n) - np.arange(len(codes))
    at = np.flatnonzero(room >= FACTOR)
    own = tn.mix(codes.astype(np.uint64) + tn.BASE * row.astype(np.uint64))
    twice, _ = tn.seen_twice(tn.chained(own, at, FACTOR))
    at = at[twice]
    kinds = int(codes.max(initial=0)) + 2

    def split(label: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.unique(label * kinds + by, return_inverse=True)[1]

    label = row[at]
    for k in range(FACTOR):
        label = split(label, codes[at + k])
    after = np.where(room[at] > FACTOR, codes[np.minimum(at + FACTOR, len(codes) - 1)], kinds - 1)
    return at, label, split(label, after)


class Partition:
    """The classes of one text's positions, as linked lists in order of position; single positions have no class."""

    def __init__(self, at: np.ndarray, before: np.ndarray, now: np.ndarray, n: int, length: int) -> None:
        """at: positions, in order; before and now: their classes for factors one word shorter than length, and of length words."""
        order = np.argsort(now, kind="stable")
        at, before, now = at[order], before[order], now[order]
        joint = now[1:] == now[:-1]
        heads = np.flatnonzero(np.r_[True, ~joint])
        sizes = np.diff(np.r_[heads, len(at)])
        by_parent = np.lexsort((-sizes, before[heads]))
        parent = before[heads][by_parent]
        small = np.ones(len(heads), bool)
        small[by_parent[np.r_[True, parent[1:] != parent[:-1]]]] = False
        #: Classes that aren't the largest part of their former class.
        self.small = [at[heads[k] : heads[k] + sizes[k]].tolist() for k in np.flatnonzero(small)]
        cls, after, prior = (np.full(n + 1, -1, np.int32) for _ in range(3))
        shared = np.repeat(sizes > 1, sizes)
        cls[at[shared]] = np.repeat(np.arange(len(heads)), sizes)[shared]
        left, right = at[:-1][joint], at[1:][joint]
        after[left], prior[right] = right, left
        self.cls, self.next, self.prior = (array("i", x.tobytes()) for x in (cls, after, prior))
        self.head, self.size, self.length = at[heads].tolist(), sizes.tolist(), length
        gap = right - left
        self.gaps = Counter(dict(zip(*(x.tolist() for x in np.unique(gap, return_counts=True)), strict=True)))
        #: Neighbours by gaps that factors haven't reached yet.
        self.ahead: dict[int, list[int]] = defaultdict(list)
        for i, g in zip(left[gap >= length].tolist(), gap[gap >= length].tolist(), strict=True):
            self.ahead[g].append(i)
        self.wide = sum(c for g, c in self.gaps.items() if 2 * g > length)

    def _count(self, gap: int, by: int) -> None:
        self.gaps[gap] += by
        if 2 * gap > self.length:
            self.wide += by

    def _join(self, a: int, b: int) -> None:
        self.next[a], self.prior[b] = b, a
        self._count(b - a, 1)
        if b - a >= self.length:
            self.ahead[b - a].append(a)

    def _leave(self, i: int, c: int) -> None:
        a, b = self.prior[i], self.next[i]
        if a >= 0:
            self._count(i - a, -1)
            self.next[a] = b
        else:
            self.head[c] = b
        if b >= 0:
            self._count(b - i, -1)
            self.prior[b] = a
            if a >= 0:
                self._join(a, b)

    def squares(self) -> list[int]:
        """Where squares of period length start."""
        p = self.length
        return [i for i in set(self.ahead.pop(p, ())) if self.next[i] == i + p]

    def refine(self) -> None:
        """Takes factors one word longer."""
        moved: dict[int, list[list[int]]] = {}
        for members in self.small:
            own: dict[int, list[int]] = {}
            for x in members:
                if x and (c := self.cls[x - 1]) >= 0:
                    own.setdefault(c, []).append(x - 1)
            for c, part in own.items():
                moved.setdefault(c, []).append(part)
        self.length += 1
        if self.length % 2 == 0:
            self.wide -= self.gaps[self.length // 2]
        self.small = []
        for c, parts in moved.items():
            rest = self.size[c] - sum(map(len, parts))
            if not rest and len(parts) == 1:
                continue
            largest = max(parts, key=len)
            if len(largest) > rest:  # it stays in place, and what is left moves
                parts.remove(largest)
                if rest:
                    gone, i, left = {x for part in [*parts, largest] for x in part}, self.head[c], []
                    while i >= 0:
                        if i not in gone:
                            left.append(i)
                        i = self.next[i]
                    parts.append(left)
            for part in parts:
                for i in part:
                    self._leave(i, c)
                self.size[c] -= len(part)
                self._open(part)
            if self.size[c] == 1:
                self.cls[self.head[c]] = -1
            self.small += parts

    def _open(self, part: list[int]) -> None:
        """Makes a class of positions that have left theirs."""
        own = len(self.size) if len(part) > 1 else -1
        for i in part:
            self.cls[i], self.next[i], self.prior[i] = own, -1, -1
        if own >= 0:
            self.head.append(part[0])
            self.size.append(len(part))
            for a, b in zip(part[:-1], part[1:], strict=True):
                self._join(a, b)


def _longer_squares(at: np.ndarray, before: np.ndarray, now: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Start and period of all squares of more than FACTOR words' period in one text."""
    classes, start, period = Partition(at, before, now, n, FACTOR + 1), [], []
    while True:
        found = classes.squares()
        start += found
        period += [classes.length] * len(found)
        if not classes.wide or not classes.small:
            return start, period
        classes.refine()


def runs_of(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of all texts, by start, then period. first: the words before each text."""
    at, short, long = _first_classes(codes, first)
    order = np.argsort(short, kind="stable")
    joint = short[order[1:]] == short[order[:-1]]
    left, gap = at[order[:-1]][joint], np.diff(at[order])[joint]
    start, period = [left[gap <= FACTOR]], [gap[gap <= FACTOR]]
    # all classes of the other texts lie in runs that FACTOR words show
    for row in np.unique(np.searchsorted(first, left[2 * gap > FACTOR], "right") - 1).tolist():
        a, b = np.searchsorted(at, first[row : row + 2])
        found = _longer_squares(at[a:b] - first[row], short[a:b], long[a:b], int(first[row + 1] - first[row]))
        start.append(np.array(found[0], np.int64) + first[row])
        period.append(np.array(found[1], np.int64))
    start, period = np.concatenate(start), np.concatenate(period)
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    heads = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])]) if len(start) else np.zeros(0, np.int64)
    q, a = period[heads], start[heads]
    size = np.diff(np.r_[heads, len(start)]) - 1 + q + np.maximum(q, FACTOR)
    keep = np.flatnonzero(size >= np.maximum(LEAST, 2 * q))
    keep = keep[np.lexsort((q[keep], a[keep]))]
    return a[keep], size[keep], q[keep]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "text", SLICE):
            data, at = tn.raw(part.column("text"))
            start, end, first = tn.words(data, at)
            a, size, q = runs_of(tn.interned(data, start, end), first)
            steps = np.zeros(len(start) + 1, np.int32)
            np.add.at(steps, a + q, 1)
            np.subtract.at(steps, a + size, 1)
            keep = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
            out, _, _, ends = tn.respaced(data, at, start[keep], end[keep], np.searchsorted(keep, first))
            row = np.searchsorted(first, a, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (a - first[row], size, q)], names=["start", "length", "period"])
            offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
            texts = pa.Array.from_buffers(pa.string(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(offsets, runs), texts], names=["doc_id", "n_words", "runs", "collapsed"])


def collapsed(docs: DataFrame) -> DataFrame:
    """Per document: n_words, runs (start, length and period in words, by start, then period) and collapsed.

    A run is a stretch of words with smallest period q, of max(LEAST, 2 q) words or more, that can't be longer to either
    side. collapsed: the words but those that a run holds behind its first q words, joined by one space.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_found, _DDL)


def longest(runs: Column) -> Column:
    """The run of most words; of several the first, and of those the one of least period. Null without runs."""
    by = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(by["start"].alias("start"), (-by["size"]).alias("length"), by["period"].alias("period")))


def listed(runs: Column) -> Column:
    """Each run as start,length,period and a line feed."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_tails(docs: DataFrame) -> DataFrame:
    """docs with periodic tails: where h = crc32 of the id is 0 modulo 10, words from g % n on repeat with a period of a third to a tenth of their number, g being h / 10.

    Such a text's words are joined by one space. A null id or a text without words changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    # arrays of one bind what is computed once for a text
    words = F.array(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))

    def repeated(w: Column) -> Column:
        n = F.size(w)

        def tail(a: Column) -> Column:
            p = F.array((F.floor((n - a) / (3 + g % 8)) + 1).cast("int"))
            return F.transform(p, lambda p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "))

        return F.get(F.get(F.transform(F.array((g % n).cast("int")), tail), F.lit(0)), F.lit(0))

    new = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(new, "text")).otherwise(F.col("text")))
