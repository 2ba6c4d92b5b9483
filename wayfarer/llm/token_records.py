"""Token ids as length-delimited binary records, with an offset index beside them.

Files are in ascending doc_id order, a shard for each partition. A record is the payload's length (64 bits)
and that length's masked checksum (32), the payload and its masked checksum (32), then a newline; all
numbers are little-endian. A payload is doc_id (64), the bytes of an id (8; plus 128 where doc_id is null) and
the ids. Ids take two bytes if the vocabulary allows it. Checksums are CRC-32, rotated right by 15 bits plus a constant, so that
checksums of data that holds checksums stay sound. The index has file, offset and length of each record for
reads in any order. Files are read as streams, or record by record from their offsets, so a shard may be of any
size. Spark's text writer writes the records: it takes the bytes of a string as they are, valid UTF-8 or not.

Defined cases: null text is empty; a null doc_id comes first and reads back as null; rows that share a
doc_id follow each other by text hash; an empty table gives no shards and an empty index; further columns
are ignored.
"""

from __future__ import annotations

import io
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, groupby
from typing import BinaryIO
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import input_bytes, stash, texts

END = 1
#: Words that are kept, bytes of their letters and ids, and bytes of the longest word that is: where no spaces part a text, it is one word.
KEPT, KEPT_BYTES, LONGEST = 2_000_000, 64 << 20, 256
MASK = 0xA282EAD8
NULL = 0x80
SHARD_BYTES = 128 << 20
_MARKS = set(".,;:!?")
_INDEX = "file string, shard int, doc_id long, offset long, length long, before long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, width | (NULL if doc_id is None else 0)) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))  # the writer ends it


def records(file: BinaryIO, at: int = 0) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Offset, doc_id and ids of each record from here on; ValueError where a checksum doesn't hold."""
    while head := file.read(12):
        size, check = struct.unpack("<QI", head) if len(head) == 12 else (0, -1)
        if check != masked(head[:8]):
            raise ValueError(f"damaged length at byte {at}")
        rest = file.read(size + 5)
        payload = rest[:size]
        if len(rest) < size + 4 or struct.unpack_from("<I", rest, size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, width = struct.unpack_from("<qB", payload)
        yield at, None if width & NULL else doc_id, np.frombuffer(payload, f"<u{width & ~NULL}", offset=9)
        at += 12 + size + 5


def _plain(word: str) -> bool:
    """Lower-case letters of composed Latin only, which normalizing and splitting leave as they are."""
    return word.isalpha() and max(word) < "\u0250" and word == word.lower() and unicodedata.is_normalized("NFC", word)


class _Grown:
    """An array that values are added to."""

    def __init__(self, kind: str | type) -> None:
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def append(self, x: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(x)
        if self.used > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(len(self.data) + len(x), self.data.dtype)])
        self.data[at : self.used] = x
        return at

    def values(self) -> np.ndarray:
        return self.data[: self.used]


class Words:
    """Ids of the words met so far, in arrays sorted by the words' hashes: some sixty bytes a word. A word found is compared.

    White space parts words, and a mark behind letters is a word of its own, so that neither changes the
    ids before it; ASCII letters are lower-cased by the tokenizer in any case.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(model)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # for what the tokenizer's normalizer and splitter leave as it is: whole texts of words that spaces part
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.marks = {m: self._plainly(m) for m in _MARKS}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.from_, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.spelled = _Grown(f"<u{self.width}"), _Grown(np.uint8)

    def _plainly(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's start and the last one's end. Each distinct word is looked up once."""
        data, at = tn.raw(column)
        start, end, first = tn.words(data, at)
        size = end - start
        letters = data[np.repeat(start, size) + tn.run_of(size)]
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, *(pa.py_buffer(x) for x in (np.r_[0, np.cumsum(size)], letters))]).dictionary_encode()
        which, kinds = every.indices.to_numpy(), every.dictionary
        if len(self.keys) > KEPT or self.flat.used * self.width + self.spelled.used > KEPT_BYTES:
            self._forget()
        letters, ends = tn.raw(kinds)
        hashes = tn.hashes(letters, ends[:-1], ends[1:])
        place, brief = np.searchsorted(self.keys, hashes), np.diff(ends) <= LONGEST
        new = np.flatnonzero(brief & (self.keys[np.minimum(place, len(self.keys) - 1)] != hashes)) if len(self.keys) else np.flatnonzero(brief)
        if len(new):
            new = new[np.unique(hashes[new], return_index=True)[1]]  # of new words with one hash only the first is kept
            self._add(hashes[new], place[new], self._ids([x.decode() for x in kinds.take(pa.array(new)).to_pylist()]), letters, ends[:-1][new], ends[1:][new])
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            count, begin = self.size[place], self.at[place]
            other = np.flatnonzero(~brief | ~self._spelled(place, letters, ends))
        else:
            count, begin, other = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        flat = self.flat.values()
        if len(other):  # long words, and words whose hash another word has
            found = [np.frombuffer(x, flat.dtype) for x in self._ids([x.decode() for x in kinds.take(pa.array(other)).to_pylist()])]
            count[other] = [len(x) for x in found]
            begin[other] = len(flat) + np.cumsum(count[other]) - count[other]
            flat = np.concatenate([flat, *found])
        count, begin = count[which], begin[which]
        return flat[np.repeat(begin, count) + tn.run_of(count)], np.r_[0, np.cumsum(count)][first]

    def _spelled(self, place: np.ndarray, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """If the words kept at these places are spelled as given."""
        size = np.diff(ends)
        out = self.length[place] == size
        at = np.flatnonzero(out & (size > 0))
        n = size[at]
        same = self.spelled.values()[np.repeat(self.from_[place[at]], n) + tn.run_of(n)] == letters[np.repeat(ends[:-1][at], n) + tn.run_of(n)]
        out[at] = np.logical_and.reduceat(same, np.cumsum(n) - n) if len(at) else out[at]
        return out

    def _add(self, keys: np.ndarray, place: np.ndarray, found: list[bytes], letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size, length = np.fromiter(map(len, found), np.int64, len(found)) // self.width, end - start
        at = self.flat.append(np.frombuffer(b"".join(found), f"<u{self.width}")) + np.cumsum(size) - size
        from_ = self.spelled.append(letters[np.repeat(start, length) + tn.run_of(length)]) + np.cumsum(length) - length
        for name, x in (("keys", keys), ("at", at), ("size", size), ("from_", from_), ("length", length)):
            setattr(self, name, np.insert(getattr(self, name), place, x))

    def _ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        letters, where, tails = [], [], []
        for k, w in enumerate(words):
            stem, tail = (w[:-1], w[-1]) if w[-1] in _MARKS and w[:-1].isalpha() else (w, "")
            stem = stem.lower() if stem.isascii() and stem.isalpha() else stem
            if _plain(stem):
                letters.append(stem)
                where.append(k)
                tails.append(tail)
            else:
                out[k] = self._plainly(w)
        for at in range(0, len(letters), 256):
            some = letters[at : at + 256]
            e = self.lean.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(e.ids, f"<u{self.width}").tobytes()
            ends = (np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1)) * self.width).tolist()
            for k, tail, a, b in zip(where[at : at + 256], tails[at : at + 256], ends[:-1], ends[1:], strict=True):
                out[k] = ids[a:b] + self.marks[tail] if tail else ids[a:b]
        return out


@lru_cache(maxsize=2)
def words_of(model: str) -> Words:
    return Words(model)


def _framed(model: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(model)
        tail = end.to_bytes(words.width, "little")
        for batch in batches:
            for part in tn.slices(batch, "text", 2 << 20):
                ids, ends = words.of(part.column("text"))
                flat, ends = ids.tobytes(), (ends * words.width).tolist()
                frames = [frame(d, flat[a:b] + tail, words.width) for d, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    return run


def write(docs: DataFrame, model: str, path: str, end: int = END, shards: int | None = None) -> None:
    """Writes all rows' records to path. Spark's text writer commits whole files only, so a lost executor leaves no half shard."""
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // SHARD_BYTES))
    ordered = texts(docs).repartitionByRange(n, "doc_id", "k1", "k2").sortWithinPartitions("doc_id", "k1", "k2").select("doc_id", "text")
    ordered.mapInArrow(_framed(model, end), "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path)


def _opened(uri: str) -> pa.NativeFile:
    where, path = pafs.FileSystem.from_uri(quote(unquote(uri), safe="/:"))
    return where.open_input_file(path)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]

    def rows_of(file: str) -> Iterator[tuple]:
        shard, before = int(re.search(r"part-(\d+)", file)[1]), 0
        with _opened(file) as opened, io.BufferedReader(opened, 8 << 20) as stream:
            for offset, doc_id, ids in records(stream):
                yield file, shard, doc_id, offset, 12 + 9 + ids.nbytes + 5, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                before += len(ids)

    for batch in batches:
        for file in batch.column("path").to_pylist():
            for rows in batched(rows_of(file), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, written to the shared folder beside the shards. It is made by reading them back, each verified on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return stash(files.mapInArrow(_listed, _INDEX), "token-index")


def starts(found: DataFrame) -> DataFrame:
    """The index with start: the ids of all records before, in file order. The running total is over shards, one row each."""
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    return found.join(base, "shard").withColumn("start", F.col("base") + F.col("before"))


def read_at(found: DataFrame) -> DataFrame:
    """doc_id and ids of the records of an index in any order or part; of a file only these records are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for file, rows in groupby(zip(*(batch.column(x).to_pylist() for x in ("file", "offset", "length")), strict=True), key=lambda r: r[0]):
                with _opened(file) as opened:
                    for _, offset, length in rows:
                        opened.seek(offset)
                        got.append(next(records(io.BytesIO(opened.read(length)), offset))[1:])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([ids.astype(np.int32) for _, ids in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    wanted = found.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / SHARD_BYTES)).sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, "doc_id long, ids array<int>")
