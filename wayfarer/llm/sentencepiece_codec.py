"""SentencePiece encoding and decoding with a table of prefixes.

A sequence of pieces is the merge-type encoding of its text just when each two neighbours are the encoding
of their own text. So the last piece of each prefix is unique: of the pieces that an automaton finds to end
there, the one that is compatible with the last piece of the prefix before it. Those last pieces are all
that is stored; the ids are read off backwards. Text is taken in parts that no piece crosses (a part starts
with the spaces before a word), and each worker keeps the parts it met last, so that frequent words cost a
lookup.

Defined cases: null text is empty and has no ids; characters without a piece become their UTF-8 bytes;
U+2581 in a text is a space, as in the library; a model with other settings raises ValueError; a null doc_id is kept; repeated rows are encoded each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import texts

SPACE = "▁"
#: Bytes of a generation of parts or stretches, and characters of the longest that is kept: where no spaces part a text, it is one part.
KEPT_BYTES, LONGEST, BRIEF = 32 << 20, 128, 24
PAIRS_KEPT = 300_000
#: Texts that show a model's normalization, its treatment of white space and its fallback to bytes.
PROBES = ("a", " a", "a ", "  a  b  ", "A\tb\nc\r\n", "\ufb01 \u212b e\u0301 \u00e9 \u3000x\u00a0y", "\u2581a\u2581", "\u200bz\ufeff", "\U0001f642\x00\x1f", "<s> </s> <unk>")


class PrefixTable:
    def __init__(self, model: str) -> None:
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        if any(p.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces, which are split again, aren't supported")
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.score = {p.id_to_piece(i): p.get_score(i) for i in plain}
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("pieces that cross from one word to the next aren't supported")
        self.automaton = ahocorasick.Automaton()
        for x in self.ids:
            self.automaton.add_word(x, (x, len(x)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        # pieces defined by a user have the score 0, as the first merge has
        marked = [f"x{x}y {x}" for x in self.ids if self.score[x] == 0]
        for text in (*PROBES, *marked):
            if p.encode(text) != self.encoded("".join(SPACE + x[1:].replace(" ", SPACE) for x in re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")))):
                raise ValueError(f"models that normalize text, treat white space another way or have pieces of a user aren't supported: {text!r}")

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: of all neighbours that make a piece, the best and leftmost merge first."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                score = self.score.get(out[k] + out[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            found = self.fits[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return found

    def pieces(self, text: str) -> list[str]:
        last, n, settled, fits = [""], 1, -1, self.fits
        for at, (piece, size) in self.automaton.iter(text):  # by where they end
            if at == settled:
                continue
            while n <= at:  # characters without a piece, or whose pieces don't fit
                last.append(text[n - 1])
                n += 1
            pair = (last[at + 1 - size], piece)
            fit = fits.get(pair)
            if self.compatible(*pair) if fit is None else fit:
                last.append(piece)
                n += 1
                settled = at
        last += text[n - 1 :]
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def encoded(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.pieces(text):
            known = self.ids.get(x)
            out.extend([known] if known is not None else [self.bytes[b] for b in x.encode()])
        return out

    @property
    def spelled(self) -> dict[int, bytes]:
        return {i: x.replace(SPACE, " ").encode() for x, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}


class Kept(dict):
    """Bytes by text, of the texts met last, in two generations: when the young one has KEPT_BYTES it becomes the old one, from which texts in use come back."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}
        self.size = 0

    def keep(self, text: str, found: bytes) -> bytes:
        if len(text) <= LONGEST:
            self.size += 4 * len(text) + len(found) + 200
            if self.size > KEPT_BYTES:
                self.old, self.size = dict(self), 0
                self.clear()
            self[text] = found
        return found


class Stretches(Kept):
    """Ids as decimals of stretches that no piece leaves. Decoding one gives the stretch itself, but for those in `other`, which aren't kept."""

    def __init__(self, table: PrefixTable) -> None:
        super().__init__()
        self.table, self.spelled = table, table.spelled
        self.decimal = {i: b"%d" % i for i in self.spelled}
        self.other: dict[str, bytes] = {}

    def made(self, text: str) -> bytes:
        ids = self.table.encoded(text)
        decoded = b"".join([self.spelled[i] for i in ids])
        if decoded != _spaced(text):
            self.other[text] = decoded
        return b",".join([self.decimal[i] for i in ids])

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.made(text)
            if text in self.other:
                return found
        return self.keep(text, found)


class Parts(Kept):
    """Ids as decimals of the parts met last, by the part without its first space.

    A part of more than BRIEF characters is encoded stretch by stretch: between two characters that are neighbours in no piece nothing merges.
    Decoding a part gives the part itself, but for the parts in `other`, of the text at hand.
    """

    def __init__(self, table: PrefixTable) -> None:
        super().__init__()
        self.stretches, self.other = Stretches(table), {}
        self.pairs = {x[k : k + 2] for x in table.ids for k in range(len(x) - 1)}

    def cut(self, text: str) -> Iterator[str]:
        start = 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in self.pairs:
                yield text[start:k]
                start = k
        yield text[start:]

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            text, other = SPACE + part, self.stretches.other
            found = self.stretches.made(text) if len(part) <= BRIEF else b",".join([self.stretches[x] for x in self.cut(text)])
            if other:
                self.other[part] = other.get(text) or b"".join([other.get(x) or _spaced(x) for x in self.cut(text)])
                other.clear()
                return found
        return self.keep(part, found)

    def of(self, text: str) -> tuple[bytes, bytes]:
        """All ids, and the text decoded from them."""
        if not text:
            return b"", b""
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = [x[1:].replace(" ", SPACE) for x in re.findall(" +[^ ]*", " " + text)]
        else:
            parts = text.split(" ")
        ids = b",".join([self[x] for x in parts])
        words = b"".join([self.other.get(x) or _plain(x) for x in parts] if self.other else map(_plain, parts))
        self.other.clear()
        return ids, words[1:]


def _spaced(text: str) -> bytes:
    return text.replace(SPACE, " ").encode()


def _plain(part: str) -> bytes:
    return b" " + _spaced(part)


@lru_cache(maxsize=2)
def parts_of(model: str) -> Parts:
    return Parts(PrefixTable(model))


def _coded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(model)
        for batch in batches:
            for part in tn.slices(batch, "text"):
                n, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids, decoded = parts.of(text)
                    n.append(ids.count(b",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(model)
        for batch in batches:
            for part in tn.slices(batch, "text"):
                ids, words = zip(*(parts.of(x) for x in part.column("text").to_pylist()), strict=True)
                lists = [[int(i) for i in x.split(b",")] if x else [] for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array([x.decode() for x in words])], names=["doc_id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    return texts(docs).select("doc_id", "text").mapInArrow(_encoded(model), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without the ids leaving the workers."""
    return texts(docs).select("doc_id", "text").mapInArrow(_coded(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
