"""Suffix-array dedup: a common-prefix-aware distributed merge sort of sparse suffixes.

A match of `length` bytes always holds, at the same offset in each place, the leftmost `gram`-byte
string of least hash, so only suffixes that start at such anchors are sorted, and of those only the
ones whose first `gram` bytes occur again. Tasks sort their suffixes into runs and front-code them:
each suffix is sent as the length it shares with the one before and the rest. Suffixes meet by a hash
of their first `gram` bytes; a loser tree merges the runs, comparing no byte within a prefix known to
be shared, and yields the order with the common-prefix lengths. What a task settles among its own rows is
dealt over all buckets by turns and passes through. The text left of the anchors is
ordered likewise. Two anchors match at `o` bytes to the left when they agree in the class of
length - o bytes of suffix and in the class of o bytes before it, which needs no comparison of pairs.

Defined cases: null text is empty; a null doc_id is kept as null; repeated rows are documents of their
own, so each removes the other; texts of fewer than `length` bytes lose nothing; texts may be of any
length (anchors are found part by part, and a periodic stretch has those of one period); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfarer.llm import textnum as tn
from wayfarer.llm.anchors import ANCHOR, SPAN, SPANS_DDL, batch, covered, dealt, listed, marked, periodic, recurring, runs_of, told, with_spans
from wayfarer.llm.common import buckets, texts

_MEMBER = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("pos", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("lcp", "<u2"), ("size", "<u2"), ("known", "u1")])
_RUN = pa.schema([("bucket", pa.int32()), ("members", pa.binary()), ("rests", pa.binary()), ("lefts", pa.binary()), ("spans", pa.binary())])
PART = 1 << 20


def _anchors(length: int, gram: int) -> Callable:
    def of(part: pa.RecordBatch) -> np.ndarray:
        data, at = tn.raw(part.column("text"))
        found, spans = [], []
        for a in range(0, max(len(data) - length + 1, 0), PART):
            here = within(data[a : a + PART + length - 1], at, a)
            keep, own = periodic(*here, length, gram, lambda x, y, p: np.array_equal(data[x : y - p], data[x + p : y]))
            found.append([x[keep] for x in here])
            spans += own
        if not found:
            return np.zeros(0, ANCHOR)
        pos, key, row, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        out = np.zeros(len(pos), ANCHOR)
        out["key"], out["pos"], out["lo"], out["hi"] = key, pos - at[row], lo, hi
        k1, k2 = (part.column(x).to_numpy() for x in ("k1", "k2"))
        out["k1"], out["k2"] = k1[row], k2[row]
        return np.concatenate([out, marked(spans, at[:-1], k1, k2)]) if spans else out

    def within(data: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """Place, hash and row of each anchor of these bytes, and how far before it its strings start."""
        n = len(data)
        sums, i = tn.prefix_sums(data), np.arange(n - gram + 1)
        grams = tn.span_hash(sums, i, i + gram)
        least = tn.sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | i.astype(np.uint64), length - gram + 1)
        ends = np.clip(at - base, 0, n)
        counts = np.clip(np.minimum(ends[1:] - length + 1, n - length + 1) - ends[:-1], 0, None)
        row = np.repeat(np.arange(len(at) - 1), counts)
        starts = ends[row] + tn.run_of(counts)
        pos = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])]) if len(pos) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(pos)] - 1 if len(pos) else cut
        where = pos[cut]
        return where + base, grams[where], row[cut], where - starts[last], where - starts[cut]

    return of


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row of a padded matrix shares with the row before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, np.minimum(found, np.minimum(sizes[1:], sizes[:-1]))]


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.repeat(np.arange(len(strings)), sizes), tn.run_of(sizes)] = np.frombuffer(b"".join(strings), np.uint8)
    return out


def _runs(length: int, gram: int, n_buckets: int, at_once: int) -> Callable:
    """Sorted, front-coded runs of the suffixes at recurring anchors, a run for each bucket and block."""

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket = np.concatenate([x[0] for x in held])
        member = np.concatenate([x[1] for x in held])
        suffixes, lefts = [s for x in held for s in x[2]], [s for x in held for s in x[3]]
        order = sorted(range(len(suffixes)), key=lambda k: (bucket[k], suffixes[k], lefts[k]))
        suffixes, lefts, member, bucket = [suffixes[k] for k in order], [lefts[k] for k in order], member[order], bucket[order]
        # of suffixes alike to both sides one is sent; the others, and it, are known to recur whole
        twin = np.zeros(len(order), bool)
        twin[1:] = [a == b and c == d for a, b, c, d in zip(suffixes[1:], suffixes[:-1], lefts[1:], lefts[:-1], strict=True)]
        twin[1:] &= (member["lo"][1:] == member["lo"][:-1]) & (bucket[1:] == bucket[:-1])
        member["known"] = twin | np.r_[twin[1:], False]
        known = member[member["known"] == 1]
        spans = np.zeros(len(known), SPAN)
        spans["k1"], spans["k2"] = known["k1"], known["k2"]
        spans["start"], spans["stop"] = known["pos"] - known["hi"].astype(np.int32), known["pos"] - known["lo"].astype(np.int32) + length
        keep = np.flatnonzero(~twin)
        suffixes, lefts, member, bucket = [suffixes[k] for k in keep], [lefts[k] for k in keep], member[keep], bucket[keep]
        member["lcp"] = _common(_matrix(suffixes, length), member["size"])
        for which, a, b in runs_of(bucket):
            member["lcp"][a] = 0
            rests = b"".join([s[h:] for s, h in zip(suffixes[a:b], member["lcp"][a:b].tolist(), strict=True)])
            yield batch((which, member[a:b].tobytes(), rests, b"".join(lefts[a:b]), b""), _RUN)
        for which, one in dealt(np.concatenate([spans, *(x[4] for x in held)]), n_buckets):
            yield batch((which, b"", b"", b"", one), _RUN)

    def of(part: pa.RecordBatch) -> tuple:
        data, at = tn.raw(part.column("text"))
        found, spans = told(part, listed(part))
        row = found["row"]
        member = np.zeros(len(row), _MEMBER)
        for x in ("pos", "lo", "hi"):
            member[x] = found[x]
        member["k1"], member["k2"] = (part.column(x).to_numpy()[row] for x in ("k1", "k2"))
        member["size"] = length - member["lo"]
        where = at[row] + member["pos"]
        bucket = (tn.hashes(data, where, where + gram) % np.uint64(n_buckets)).astype(np.int64)
        whole = data.tobytes()
        suffixes = [whole[a:b] for a, b in zip(where.tolist(), (where + member["size"]).tolist(), strict=True)]
        back = whole[::-1]
        lefts = [back[a:b] for a, b in zip((len(whole) - where).tolist(), (len(whole) - where + member["hi"]).tolist(), strict=True)]
        return bucket, member, suffixes, lefts, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            for part in tn.slices(rows, "text"):
                held.append(of(part))
                n += len(held[-1][0]) + len(held[-1][4])
                if n >= at_once:
                    yield from block(held)
                    held, n = [], 0
        if n:
            yield from block(held)

    return run


def shared_from(a: bytes, b: bytes, h: int) -> int:
    """The common-prefix length of a and b, of which h bytes are known to be shared."""
    most, step = min(len(a), len(b)), 16
    while h + step <= most and a[h : h + step] == b[h : h + step]:
        h += step
    while h < most and a[h] == b[h]:
        h += 1
    return h


def merge_runs(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs: (run, index) in order, and the length that each shares with the one before.

    lcps: within each run. A node of the loser tree keeps the run that lost there and what its head
    shares with the winner; heads that share different lengths with the last output need no look at
    their bytes, and others are compared behind the shared part only.
    """
    n = 1
    while n < len(runs):
        n *= 2
    sizes = [len(x) for x in runs] + [0] * (n - len(runs))
    index, shares, loser = [0] * n, [0] * n, [0] * n
    heads: list[bytes | None] = [runs[k][0] if sizes[k] else None for k in range(n)]

    def beats(a: int, b: int) -> bool:
        """If head a goes before head b; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shares[a] != shares[b]:
            return shares[a] > shares[b]
        h = shared_from(x, y, shares[a])
        first = len(x) == h or (len(y) > h and x[h] < y[h])
        shares[b if first else a] = h
        return first

    winner = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top, order, common = winner[1], [], []
    while heads[top] is not None:
        order.append((top, index[top]))
        common.append(shares[top])
        index[top] = k = index[top] + 1
        if k < sizes[top]:
            heads[top], shares[top] = runs[top][k], lcps[top][k]
        else:
            heads[top] = None
        node = (top + n) // 2
        while node:
            other = loser[node]
            if not beats(top, other):
                loser[node], top = top, other
            node //= 2
    return order, common


def _merged(length: int, gram: int) -> Callable:
    def meet(group: pa.Table) -> pa.Table:
        spans = [np.frombuffer(x, SPAN) for x in group.column("spans").to_pylist() if x]
        runs, lcps, lefts, members = [], [], [], []
        for packed, rests, left in zip(*(group.column(x).to_pylist() for x in ("members", "rests", "lefts")), strict=True):
            if not packed:
                continue
            member, at, run, last = np.frombuffer(packed, _MEMBER), 0, [], b""
            for h, size in zip(member["lcp"].tolist(), member["size"].tolist(), strict=True):
                last = last[:h] + rests[at : at + size - h]
                at += size - h
                run.append(last)
            ends = np.cumsum(member["hi"]).tolist()
            lefts.append([left[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            runs.append(run)
            lcps.append(member["lcp"].tolist())
            members.append(member)
        if runs:
            order, common = merge_runs(runs, lcps)
            firsts = np.cumsum([0, *map(len, runs)])
            member = np.concatenate(members)[np.fromiter((firsts[r] + k for r, k in order), np.int64, len(order))]
            spans.append(matches(member, np.array(common, np.int64), [lefts[r][k] for r, k in order], length, gram))
        both = np.concatenate(spans) if spans else np.zeros(0, SPAN)
        return pa.table({x: pa.array(both[x]) for x in SPAN.names})

    return meet


def matches(member: np.ndarray, common: np.ndarray, lefts: list[bytes], length: int, gram: int) -> np.ndarray:
    """Spans of the anchors' own windows that another anchor's equal, from the merged order.

    Windows of one anchor start within length - gram bytes, so those that recur overlap to one span.
    """
    n = len(member)
    back = sorted(range(n), key=lefts.__getitem__)
    sizes = member["hi"].astype(np.int64)[back]
    same_left = _common(_matrix([lefts[k] for k in back], int(sizes.max(initial=0)) + 1), sizes)
    place = np.empty(n, np.int64)
    place[back] = np.arange(n)
    lo, hi = member["lo"].astype(np.int64), member["hi"].astype(np.int64)
    least, most = np.full(n, length), np.full(n, -1)
    for o in range(length - gram + 1):
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        right = np.cumsum(common < length - o)[own]
        left = np.cumsum(same_left < o)[place[own]]
        twice, _ = tn.seen_twice(right * (n + 1) + left)
        hit = own[twice]
        most[hit] = o
        least[hit] = np.minimum(least[hit], o)
    hit = np.flatnonzero((most >= 0) & (member["known"] == 0))
    out = np.zeros(len(hit), SPAN)
    out["k1"], out["k2"] = member["k1"][hit], member["k2"][hit]
    out["start"], out["stop"] = member["pos"][hit] - most[hit], member["pos"][hit] - least[hit] + length
    return out


def repeats(docs: DataFrame, length: int = 200, gram: int = 32, at_once: int = 400_000, run_size: int = 60_000) -> DataFrame:
    """Byte spans (k1, k2, start, stop) whose union is what strings that occur again cover. docs: as texts() gives them."""
    n = buckets(docs)
    per_row = recurring(docs, _anchors(length, gram), n, at_once)
    # all columns of docs stay, so that this join and the last one read one exchange of the texts
    runs = docs.join(per_row, ["k1", "k2"]).mapInArrow(_runs(length, gram, n, run_size), "bucket int, members binary, rests binary, lefts binary, spans binary")
    return runs.groupBy("bucket").applyInArrow(_merged(length, gram), SPANS_DDL)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "text"):
            data, at = tn.raw(part.column("text"))
            gone = covered(part, at, len(data))
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            inner = at[1:-1][at[1:-1] < len(data)]
            head[inner] = gone[inner]
            out, ends = data[~gone].tobytes(), np.r_[0, np.cumsum(~gone)][at]
            shas = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            removed, spans = (np.diff(np.r_[0, np.cumsum(x)][at]) for x in (gone, head))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(shas)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_repeats(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay."""
    rows = texts(docs)
    full = with_spans(rows, repeats(rows, length, gram)).select("doc_id", "text", "starts", "stops")
    return full.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
