"""Squared distances to the nearest of weighted sites along lines, many lines at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the lines that are looked at together.
BLOCK = 1 << 18


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def lower(at: np.ndarray, of: np.ndarray, places: np.ndarray, values: np.ndarray, sites_of: np.ndarray) -> np.ndarray:
    """For each place of each line the least of (place - site)² + value, -1 on lines without sites.

    of and sites_of: where each line's places and sites start, and where the last one's end; both are in order within a
    line. The site of the least grows with the place, so the place in the middle of a stretch parts the sites
    for the places to its left and right: log n rounds, each of which looks at a site once or twice.
    """
    best = np.full(len(at), -1, np.int64)
    a, b, lo, hi = of[:-1], of[1:] - 1, sites_of[:-1], sites_of[1:] - 1
    some = (a <= b) & (lo <= hi)
    a, b, lo, hi = a[some], b[some], lo[some], hi[some]
    while len(a):
        middle, counts = (a + b) // 2, hi - lo + 1
        site = np.repeat(lo, counts) + _within(counts)
        far = np.square(np.repeat(at[middle], counts) - places[site]) + values[site]
        heads = np.cumsum(counts) - counts
        least = np.minimum.reduceat(far, heads)
        best[middle] = least
        first = np.flatnonzero(far == np.repeat(least, counts))
        own = np.repeat(np.arange(len(a)), counts)[first]
        cut = site[first[np.r_[True, own[1:] != own[:-1]]]]
        a, b, lo, hi = np.r_[a, middle + 1], np.r_[middle - 1, b], np.r_[lo, cut], np.r_[cut, hi]
        some = a <= b
        a, b, lo, hi = a[some], b[some], lo[some], hi[some]
    return best


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (grid_id, col and the lists row and dx, null where no site is in reach of a cell's own row) to cells (grid_id, row, col, d2)."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("row")).to_numpy(zero_copy_only=False).astype(np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
            part, n = batch.slice(start, stop - start), sizes[start:stop]
            start = stop
            row, dx = part.column("row").flatten().to_numpy().astype(np.int64), part.column("dx").flatten()
            there, of = dx.is_valid().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)]
            squares = np.square(pc.fill_null(dx, 0).to_numpy().astype(np.int64))
            d2 = lower(row, of, row[there], squares[there], np.r_[0, np.cumsum(there)][of])
            line = pa.array(np.repeat(np.arange(len(part)), n))
            yield pa.RecordBatch.from_arrays([part.column("grid_id").take(line), pa.array(row.astype(np.int32)), part.column("col").take(line), pa.array(d2, mask=d2 < 0)], names=["grid_id", "row", "col", "d2"])
