"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of benchmark words. A shift table over blocks of two words says how far the search
may jump from a position; where it may not, a bucket by the hash of the block that ends there selects
the patterns to test, and a comparison of the text itself confirms an occurrence. All segments of a
batch are searched at once, each with a cursor of its own. The benchmark's distinct rows are dealt to blocks of bounded
size, and one task a block makes its tables and writes them to the shared folder as flat arrays, which workers map. A task
takes one block after the other to a bounded stretch of its documents, so neither the driver nor a worker holds more than a
block (or an item, if that is larger), each block's tables are made once, and the documents are read once.

Defined cases: null text has no words; an item without words has no windows; a null item_id is written
as "null"; rows that repeat an item_id count as one item; a null doc_id is kept; repeated rows are
reported each; an empty benchmark hits nothing; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import shared_dir, texts, whole_rows

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
SEPARATORS = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Slots of a shift table: PER_BLOCK for each block of its patterns, within these powers of two.
LEAST_SLOTS, MOST_SLOTS, PER_BLOCK = 20, 26, 4
BLOCK_BYTES = 16 << 20
STRETCH = 32 << 20
SEGMENT = 256


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tn.mix(a * tn.BASE + b)


#: A pattern set as arrays: shift table, suffix blocks (sorted), hash of the first word, where each pattern starts and ends in the items' text, its items and where they start.
_ARRAYS = {"shift": "u1", "suffix": "<u8", "heads": "<u8", "start": "<i8", "end": "<i8", "owner": "<i4", "owner_at": "<i8"}
_FILE = pa.schema([("words", pa.int64()), *((x, pa.large_binary()) for x in _ARRAYS), ("text", pa.large_binary()), ("items", pa.large_list(pa.string()))])


def pattern_sets(items: list[str], texts: pa.Array, window: int) -> Iterator[dict]:
    """The pattern sets of items by length, as rows of _FILE; the first has all items' words, joined by one space, and the items' names."""
    data, at = tn.raw(texts)
    start, end, first = tn.words(tn.LOWER[data], at, SEPARATORS)
    text, start, end, _ = tn.respaced(tn.LOWER[data], at, start, end, first)
    yield {"words": 0, "text": text, "items": items}
    low = np.frombuffer(text, np.uint8)
    h, codes = tn.hashes(low, start, end), tn.interned(low, start, end)
    kinds, n = int(codes.max(initial=0)) + 1, np.diff(first)
    for words in np.unique(np.minimum(n[n > 0], window)).tolist():
        whole = np.flatnonzero((n == words) | (n >= window) & (words == window))
        per = n[whole] - words + 1
        pos, item = np.repeat(first[whole], per) + tn.run_of(per), np.repeat(whole, per)
        same = np.unique(codes[pos], return_inverse=True)[1]
        for k in range(1, words):
            same = np.unique(same * kinds + codes[pos + k], return_inverse=True)[1]
        pair = np.unique(same * len(items) + item)  # each pattern's items
        _, head = np.unique(same, return_index=True)
        pos = pos[head]
        block = min(2, words)
        blocks = h[pos[:, None] + np.arange(words)] if block == 1 else _pair(h[pos[:, None] + np.arange(words - 1)], h[pos[:, None] + np.arange(1, words)])
        slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (PER_BLOCK * blocks.size).bit_length()))
        shift = np.full(slots, words - block + 1, np.uint8)
        for k in range(blocks.shape[1]):  # the later a block, the less the shift
            shift[(blocks[:, k] & np.uint64(slots - 1)).astype(np.int64)] = blocks.shape[1] - 1 - k
        order = np.argsort(blocks[:, -1], kind="stable")
        counts = np.bincount(pair // len(items), minlength=len(pos))
        begin = np.r_[0, np.cumsum(counts)]
        owner = (pair % len(items))[np.repeat(begin[:-1][order], counts[order]) + tn.run_of(counts[order])]
        arrays = {"shift": shift, "suffix": blocks[order, -1], "heads": h[pos[order]], "start": start[pos[order]], "end": end[pos[order] + words - 1], "owner": owner, "owner_at": np.r_[0, np.cumsum(counts[order])]}
        yield {"words": words} | {x: v.astype(_ARRAYS[x]).tobytes() for x, v in arrays.items()}


class Patterns:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, words: int, arrays: dict[str, np.ndarray]) -> None:
        self.words, self.block = words, min(2, words)
        self.shift, self.suffix, self.heads, self.start, self.end, self.owner, self.owner_at = (arrays[x] for x in _ARRAYS)
        self.mask = np.uint64(len(self.shift) - 1)

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of all candidates whose suffix block and first word agree."""
        lows, highs = [], []
        for cut in range(0, int(np.diff(first).max(initial=0)), SEGMENT):
            low = first[:-1] + max(cut, self.words - 1)
            high = np.minimum(first[:-1] + cut + SEGMENT, first[1:])
            lows.append(low[low < high])
            highs.append(high[low < high])
        none = np.zeros(0, np.int64)
        at, stop = (np.concatenate(x) if x else none for x in (lows, highs))
        stops = []
        while len(at):
            block = h[at] if self.block == 1 else _pair(h[at - 1], h[at])
            step = self.shift[(block & self.mask).astype(np.int64)]
            stops.append((at[step == 0], block[step == 0]))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not stops:
            return none, none
        at, block = (np.concatenate(x) for x in zip(*stops, strict=True))
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        at = np.repeat(at, hi - lo)
        which = np.repeat(lo, hi - lo) + tn.run_of(hi - lo)
        good = h[at - self.words + 1] == self.heads[which]
        return at[good], which[good]


class Block:
    """A block of the benchmark: its pattern sets, text and items, as views of its file."""

    def __init__(self, table: pa.Table) -> None:
        def cell(name: str, row: int) -> pa.Buffer:
            return table.column(name)[row].as_buffer()

        self.text = cell("text", 0)
        self.items: list[str] = table.column("items")[0].as_py()
        self.sets = [Patterns(n, {x: np.frombuffer(cell(x, row), kind) for x, kind in _ARRAYS.items()}) for row, n in enumerate(table.column("words").to_pylist()) if n]


class _Searched:
    """A slice of documents, and what the blocks so far hit in it."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.part = part
        data, at = tn.raw(part.column("text"))
        data = tn.LOWER[data]
        start, end, self.first = tn.words(data, at, SEPARATORS)
        self.hashes = tn.hashes(data, start, end)
        self.text, self.start, self.end, _ = tn.respaced(data, at, start, end, self.first)
        self.items: dict[int, set[str]] = defaultdict(set)
        self.heads, self.tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def look(self, block: Block) -> None:
        theirs = memoryview(block.text).cast("B")
        for patterns in block.sets:
            last, which = patterns.search(self.hashes, self.first)
            head = last - patterns.words + 1
            spans = zip(self.start[head].tolist(), self.end[last].tolist(), patterns.start[which].tolist(), patterns.end[which].tolist(), strict=True)
            true = np.fromiter((self.text[x:y] == theirs[a:b] for x, y, a, b in spans), bool, len(last))
            last, which, head = last[true], which[true], head[true]
            row = np.searchsorted(self.first, last, "right") - 1
            for r, k in set(zip(row.tolist(), which.tolist(), strict=True)):
                self.items[r].update(block.items[i] for i in patterns.owner[patterns.owner_at[k] : patterns.owner_at[k + 1]].tolist())
            self.heads.append(head)
            self.tails.append(last + 1)

    def result(self, carried: list[str]) -> pa.RecordBatch:
        # one empty word at each row's end keeps rows apart when spans are joined
        first, heads, tails = self.first, np.concatenate(self.heads), np.concatenate(self.tails)
        row = np.searchsorted(first, heads, "right") - 1
        s, e = tn.merged(heads + row, tails + row)
        row = np.searchsorted(first + np.arange(len(first)), s, "right") - 1
        s, e = s - row - first[row], e - row - first[row]
        bounds = pa.array(np.searchsorted(row, np.arange(len(self.part) + 1)).astype(np.int32))
        items = pa.array([sorted(self.items[r]) if r in self.items else [] for r in range(len(self.part))], pa.list_(pa.string()))
        found = [pa.array(np.diff(first)), *(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (s, e)), items]
        return pa.RecordBatch.from_arrays([self.part.column(x) for x in carried] + found, names=[*carried, *(f.name for f in _FOUND)])


def _build(uri: str, window: int) -> Callable:
    """Writes a block's pattern sets to the shared folder. A task that runs again replaces its own file."""

    def run(group: pa.Table) -> pa.Table:
        where, path = pafs.FileSystem.from_uri(uri)
        k = group.column("block")[0].as_py()
        where.create_dir(path, recursive=True)
        own = f"{path}/.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as out, pa.ipc.new_file(out, _FILE) as file:
            for row in pattern_sets(group.column("item").to_pylist(), pa.concat_arrays(group.column("text").chunks), window):
                file.write(pa.record_batch([pa.array([row.get(f.name)], f.type) for f in _FILE], schema=_FILE))
        where.move(own, f"{path}/{k}.arrow")
        return pa.table({"block": pa.array([k], pa.int32())})

    return run


@lru_cache(maxsize=1)
def _block(uri: str, k: int) -> Block | None:
    """A block's file, mapped where the shared folder is mounted; None if no item was dealt to the block."""
    where, path = pafs.FileSystem.from_uri(uri)
    file = f"{path}/{k}.arrow"
    if where.get_file_info(file).type == pafs.FileType.NotFound:
        return None
    source = pa.memory_map(file) if isinstance(where, pafs.LocalFileSystem) else where.open_input_file(file)
    return Block(pa.ipc.open_file(source).read_all())


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[_Searched]]:
    held, used = [], 0
    for batch in batches:
        for part in tn.slices(batch, "text"):
            held.append(_Searched(part))
            used += len(held[-1].text)
            if used >= size:
                yield held
                held, used = [], 0
    if held:
        yield held


def _hits(uri: str, n: int, carried: list[str], stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches, stretch if n > 1 else 1):
            for k in range(n):
                if block := _block(uri, k):
                    for one in held:
                        one.look(block)
            for one in held:
                yield one.result(carried)

    return run


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("starts", "stops")), T.StructField("items", T.ArrayType(T.StringType()))])


def found_in(rows: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """The columns of rows but text, and n_words, the hit word spans (starts, stops) and the items whose windows occur."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    n = int((tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    uri = shared_dir(rows.sparkSession, "benchmark")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    dealt = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    dealt.groupBy("block").applyInArrow(_build(uri, window), "block int").write.format("noop").mode("overwrite").save()
    carried = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_hits(uri, n, [f.name for f in carried], stretch), T.StructType([*carried, *_FOUND]))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """Per document its doc_id and what found_in says."""
    return found_in(texts(docs).select("doc_id", "text"), benchmark, window, block_bytes, stretch)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, shas = [], []
        for starts, stops, items in zip(*(batch.column(x).to_pylist() for x in ("starts", "stops", "items")), strict=True):
            s, e = tn.merged(np.array(starts, np.int64), np.array(stops, np.int64))
            hit.append(int((e - s).sum()))
            shas.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        counts = pa.compute.list_value_length(batch.column("items")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), counts, pa.array(shas, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    return hits(docs, benchmark, window).mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the contaminated rows. Each row goes with its own hits, so no text is shuffled."""
    return found_in(whole_rows(docs), benchmark, window).where(F.size("starts") == 0).select("row.*")
