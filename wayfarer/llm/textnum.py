"""Numpy kernels over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
#: \x20 and \x09-\x0D, the separators of the word rule [^\x20\x09-\x0D]+.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about limit bytes of text each; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and the last one ends."""
    if array.null_count:
        array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n at least."""
    return _powers(1 << max(21, int(n).bit_length()))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, from which span_hash gives the hash of any span."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span: its 8-byte parts one after the other, each through the finalizer; XXH64 of long spans.

    Unlike a polynomial modulo 2^64 it has no strings that collide whatever the base. Equal hashes still
    don't prove equal spans: callers compare the bytes, or take two seeds where the docstring says so.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    from_each = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * BASE + np.uint64(seed))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (from_each[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]], seed)
    return out


def interned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal ones; spans are in order and don't overlap."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[start] += 1
    np.subtract.at(marks, end, 1)
    letters = data[np.cumsum(marks[:-1], dtype=np.int8) > 0]
    at = np.r_[0, np.cumsum(end - start)]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)])
    return found.dictionary_encode().indices.to_numpy().astype(np.int64)


def chained(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n word hashes from each place on."""
    out = h[at]
    for k in range(1, n):
        out = mix(out * BASE + h[at + k])
    return out


def words(data: np.ndarray, at: np.ndarray, is_sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each row the number of words before it (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    word = ~is_sep[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    head[cuts] = word[cuts]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    tail[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, at)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def run_of(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts, counts)


def seen_twice(keys: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each key, if it occurs again in keys, and if it is the first of its kind. other: a second half of each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if other is not None:
        agree = other[order[1:]] == other[order[:-1]]
        if (same & ~agree).any():
            order = np.lexsort((other, keys))
            same, agree = keys[order[1:]] == keys[order[:-1]], other[order[1:]] == other[order[:-1]]
        same &= agree
    twice, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    first[order[1:]] = ~same
    return twice, first


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return start[np.r_[0, cut]], reach[np.r_[cut - 1, len(start) - 1]]


def respaced(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by one space: all bytes, start and end of each word, and of each row."""
    later = np.ones(len(start), bool)
    later[first[:-1][first[:-1] < len(start)]] = False
    marks = np.zeros(len(data) + 1, np.int8)
    marks[start] += 1
    np.subtract.at(marks, end, 1)
    mask = np.cumsum(marks[:-1], dtype=np.int8) > 0
    data = data.copy()
    gap = start[later] - 1
    data[gap], mask[gap] = 0x20, True
    place = np.r_[0, np.cumsum(mask)]
    return data[mask].tobytes(), place[start], place[end], place[at]
