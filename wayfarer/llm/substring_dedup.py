"""Substring dedup by seed and extend.

Seeds are winnowed word n-grams: of every `window` consecutive words, the leftmost n-gram of the least
hash is the seed, so equal windows have their seed at equal offsets. Documents are joined on the seeds that
recur: each such occurrence is sent with the words around it that its windows reach. Matches are extended
from the seed to the right and to the left, word by word: in each step the occurrences that agreed so far
part by their next word, and those left alone stop, so no pairs are made. An occurrence's match is a repeat
where both sides reach `window` words together; overlapping repeats join into maximal ones. Words are
compared as text. Tasks settle equal surroundings among their own rows and send one of each, so a passage
that a third of the rows hold reaches the shuffle once per task.

Defined cases: null text has no words; a null doc_id is kept as null; repeated rows are documents of
their own, so each makes the other's windows repeats; texts of fewer words than a window lose
nothing; texts may be of any length (seeds are found part by part, and a periodic stretch has those of one period); a document that loses all its words
keeps the empty string; an empty table gives an empty result; further columns are ignored.
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

_MEMBER = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("pos", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("known", "u1")])
_SENT = pa.schema([("bucket", pa.int32()), ("members", pa.binary()), ("words", pa.binary()), ("spans", pa.binary())])
PART = 1 << 18


def _seeds(window: int, gram: int) -> Callable:
    def of(part: pa.RecordBatch) -> np.ndarray:
        data, at = tn.raw(part.column("text"))
        start, end, first = tn.words(data, at)
        h, row = tn.hashes(data, start, end), np.repeat(np.arange(len(part)), np.diff(first))
        found, spans = [], []

        def same(x: int, y: int, p: int) -> bool:
            words = [data[a:b].tobytes() for a, b in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)]
            return words[:-p] == words[p:]

        for a in range(0, max(len(h) - window + 1, 0), PART):
            here = _seeds_within(h[a : a + PART + window - 1], row[a : a + PART + window - 1], a)
            keep, own = periodic(*here, window, gram, same)
            found.append([x[keep] for x in here])
            spans += own
        if not found:
            return np.zeros(0, ANCHOR)
        pos, key, row, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        out = np.zeros(len(pos), ANCHOR)
        out["key"], out["pos"], out["lo"], out["hi"] = key, pos - first[row], lo, hi
        k1, k2 = (part.column(x).to_numpy() for x in ("k1", "k2"))
        out["k1"], out["k2"] = k1[row], k2[row]
        return np.concatenate([out, marked(spans, first[:-1], k1, k2)]) if spans else out

    def _seeds_within(h: np.ndarray, row: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """Place, hash and row of each seed of these words, and how far before it its windows start."""
        i = np.arange(len(h) - gram + 1)
        grams = tn.chained(h, i, gram)
        least = tn.sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | i.astype(np.uint64), window - gram + 1)
        starts = np.flatnonzero(row[: len(h) - window + 1] == row[window - 1 :])
        seed = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (row[starts[1:]] != row[starts[:-1]])]) if len(seed) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(seed)] - 1 if len(seed) else cut
        return seed[cut] + base, grams[seed[cut]], row[starts[cut]], seed[cut] - starts[last], seed[cut] - starts[cut]

    return of


def _surroundings(window: int, gram: int, n_buckets: int, at_once: int) -> Callable:
    """Recurring seeds with the words their windows reach, one of each kind for every block."""

    def of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        data, at = tn.raw(part.column("text"))
        start, end, first = tn.words(data, at)
        found, spans = told(part, listed(part))
        member = np.zeros(len(found["row"]), _MEMBER)
        for x in ("pos", "lo", "hi"):
            member[x] = found[x]
        member["k1"], member["k2"] = (part.column(x).to_numpy()[found["row"]] for x in ("k1", "k2"))
        seed = first[found["row"]] + found["pos"]
        at_words = (seed[:, None] + np.arange(gram)).ravel()
        key = tn.chained(tn.hashes(data, start[at_words], end[at_words]), np.arange(0, len(at_words), gram), gram)
        text, a, b, _ = tn.respaced(data, at, start, end, first)
        words = [text[x:y] + b" " for x, y in zip(a[seed - found["hi"]].tolist(), b[seed - found["lo"] + window - 1].tolist(), strict=True)]
        return (key % np.uint64(n_buckets)).astype(np.int64), member, words, spans

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, member = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        words = [w for x in held for w in x[2]]
        kinds: dict[tuple[bytes, int], int] = {}
        first = np.fromiter((kinds.setdefault(x, k) for k, x in enumerate(zip(words, member["hi"].tolist(), strict=True))), np.int64, len(words))
        again = np.bincount(first, minlength=len(first)) > 1
        member["known"] = again[first]  # equal around the seed as far as its windows reach: they all recur
        known = member[member["known"] == 1]
        spans = np.zeros(len(known), SPAN)
        spans["k1"], spans["k2"] = known["k1"], known["k2"]
        spans["start"], spans["stop"] = known["pos"] - known["hi"].astype(np.int32), known["pos"] - known["lo"].astype(np.int32) + window
        keep = np.flatnonzero(first == np.arange(len(first)))
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        for which, a, b in runs_of(bucket[keep]):
            at = keep[a:b]
            yield batch((which, member[at].tobytes(), b"".join([words[k] for k in at.tolist()]), b""), _SENT)
        for which, one in dealt(np.concatenate([spans, *(x[3] for x in held)]), n_buckets):
            yield batch((which, b"", b"", one), _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            for part in tn.slices(rows, "text"):
                held.append(of(part))
                n += len(held[-1][0]) + len(held[-1][3])
                if n >= at_once:
                    yield from block(held)
                    held, n = [], 0
        if n:
            yield from block(held)

    return run


def _codes(text: bytes) -> np.ndarray:
    """A number for each distinct word of a text in which a space ends every word."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(text)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)


def _extended(codes: np.ndarray, at: np.ndarray, step: int, most: np.ndarray, label: np.ndarray, upto: int) -> list[np.ndarray]:
    """For 0..upto words from `at` on: the class of the occurrences that agree that far, -1 for those that agree with none."""
    out, live = [label], np.flatnonzero(label >= 0)
    for j in range(upto):
        live = live[most[live] > j]
        key = out[-1][live].astype(np.uint64) << np.uint64(32) | codes[at[live] + step * j]
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order[1:]] != key[order[:-1]]] if len(key) else np.zeros(0, bool)
        kind = np.cumsum(fresh) - 1
        several = np.bincount(kind)[kind] > 1 if len(key) else fresh
        label = np.full(len(at), -1, np.int64)
        label[live[order[several]]] = kind[several]
        out.append(label)
        live = live[order[several]]
    return out


def matches(member: np.ndarray, codes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Spans of the seeds' own windows that another occurrence's equal.

    Windows of one seed start within window - gram words, so those that recur overlap to one span.
    """
    lo, hi = member["lo"].astype(np.int64), member["hi"].astype(np.int64)
    size = hi - lo + window
    seed = np.cumsum(size) - size + hi
    right = _extended(codes, seed, 1, window - lo, np.zeros(len(member), np.int64), window)
    left = _extended(codes, seed - 1, -1, hi, right[gram], window - gram)
    least, most = np.full(len(member), window), np.full(len(member), -1)
    for o in range(window - gram + 1):
        a, b = right[window - o], left[o]
        own = np.flatnonzero((a >= 0) & (b >= 0) & (lo <= o) & (o <= hi))
        twice, _ = tn.seen_twice(a[own] << 32 | b[own])
        hit = own[twice]
        most[hit] = o
        least[hit] = np.minimum(least[hit], o)
    hit = np.flatnonzero((most >= 0) & (member["known"] == 0))  # the sender has told the spans of the others
    out = np.zeros(len(hit), SPAN)
    out["k1"], out["k2"] = member["k1"][hit], member["k2"][hit]
    out["start"], out["stop"] = member["pos"][hit] - most[hit], member["pos"][hit] - least[hit] + window
    return out


def _met(window: int, gram: int) -> Callable:
    def meet(group: pa.Table) -> pa.Table:
        members, words, spans = (b"".join(group.column(x).to_pylist()) for x in ("members", "words", "spans"))
        found = matches(np.frombuffer(members, _MEMBER), _codes(words), window, gram)
        both = np.concatenate([found, np.frombuffer(spans, SPAN)])
        return pa.table({x: pa.array(both[x]) for x in SPAN.names})

    return meet


def repeats(docs: DataFrame, window: int = 35, gram: int = 5, at_once: int = 400_000, block: int = 60_000) -> DataFrame:
    """Word spans (k1, k2, start, stop) whose union is what windows that occur again cover. docs: as texts() gives them."""
    n = buckets(docs)
    found = recurring(docs, _seeds(window, gram), n, at_once)
    # all columns of docs stay, so that this join and the last one read one exchange of the texts
    sent = docs.join(found, ["k1", "k2"]).mapInArrow(_surroundings(window, gram, n, block), "bucket int, members binary, words binary, spans binary")
    return sent.groupBy("bucket").applyInArrow(_met(window, gram), SPANS_DDL)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for part in tn.slices(rows, "text"):
            data, at = tn.raw(part.column("text"))
            start, end, first = tn.words(data, at)
            gone = covered(part, first, len(start))
            keep = np.flatnonzero(~gone)
            out, _, _, ends = tn.respaced(data, at, start[keep], end[keep], np.searchsorted(keep, first))
            shas = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            removed = np.r_[0, np.cumsum(gone)][first]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removed_repeats(docs: DataFrame, window: int = 35, gram: int = 5) -> DataFrame:
    """Per document: n_words, n_removed and kept_sha256 of the kept words, joined by one space."""
    rows = texts(docs)
    full = with_spans(rows, repeats(rows, window, gram)).select("doc_id", "text", "starts", "stops")
    return full.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
