"""Fill-in-the-middle transformation with cuts at token boundaries.

A text is cut into tokens (a run of letters, or one other character), and its prefix and middle end after a
drawn number of them. A text counts as overlapping chunks of its bytes, each with the byte before it: whether a
token starts at a byte is said by the byte and its neighbour alone, so chunks are counted apart from each other. Sums
over the chunks before tell which chunk holds a cut, and only that one is looked through again. The draws, the
parts and what is made of them are Column expressions; a text goes to Python only to be counted, and isn't sent back.

Defined cases: null text is empty, and an empty text stays plain; a null doc_id draws as the empty string; each
row is taken for itself, so repeated rows and ties of the draws (an empty middle) are nothing special; a text of
any length is held once, its counts by CHUNK bytes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm import textnum as tn

CHUNK = 4096
#: Bytes that are looked at together.
BLOCK = 256 * CHUNK
MARKS = {"p": "<P>", "s": "<S>", "m": "<M>"}
LETTER = np.isin(np.arange(256) | 0x20, np.arange(97, 123)) & (np.arange(256) < 128)
_DDL = "n long, prefix_chars long, middle_chars long"


def _predicates(data: np.ndarray, a: int, b: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes a to b: where tokens and where characters start. heads: the bytes at which rows start, which have no neighbour before."""
    own = data[a:b]
    char = (own & 0xC0) != 0x80
    letter = LETTER[data[max(a - 1, 0) : b]]
    glued = letter[1:] & letter[:-1] if a else np.r_[False, letter[1:] & letter[:-1]]
    glued[heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a] = False
    return char & ~glued, char


def counted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all rows: first byte of each (and the end), tokens and characters before each, and each row's first chunk."""
    per_row = -(-np.diff(at) // CHUNK)
    first = np.r_[0, np.cumsum(per_row)]
    start = np.r_[np.repeat(at[:-1], per_row) + CHUNK * tn.run_of(per_row), at[-1]]
    tokens, chars = (np.zeros(len(start), np.int64) for _ in range(2))
    k = 0
    while k < len(start) - 1:
        stop = max(k + 1, int(np.searchsorted(start, start[k] + BLOCK, "right")) - 1)
        begins, char = _predicates(data, start[k], start[stop], at[:-1])
        for out, found in ((tokens, begins), (chars, char)):
            out[k + 1 : stop + 1] = np.add.reduceat(found, start[k:stop] - start[k], dtype=np.int64)
        k = stop
    return start, np.cumsum(tokens), np.cumsum(chars), first


def cuts(text: pa.Array, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each row, and in rows of two the characters before each row's two cuts. draws: two numbers a row, taken modulo tokens + 1."""
    data, at = tn.raw(text)
    start, tokens, chars, first = counted(data, at)
    n = tokens[first[1:]] - tokens[first[:-1]]
    ranks = np.sort(np.stack([x % (n + 1) for x in draws], axis=1), axis=1)
    out = np.repeat((chars[first[1:]] - chars[first[:-1]])[:, None], 2, axis=1)  # a cut after the last token
    for row, side in np.argwhere(ranks < n[:, None]).tolist():
        a, b = first[row], first[row + 1]
        rank = tokens[a] + ranks[row, side]
        own = int(np.searchsorted(tokens[a + 1 : b + 1], rank, "right")) + a
        begins, char = _predicates(data, start[own], start[own + 1], at[row : row + 1])
        byte = np.flatnonzero(begins)[rank - tokens[own]]
        out[row, side] = chars[own] - chars[a] + np.count_nonzero(char[:byte])
    return n, out


def _measured(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, *draws in columns:
        n, out = cuts(text, [x.to_numpy(zero_copy_only=False) for x in draws])
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(out[:, 0]), pa.array(out[:, 1] - out[:, 0])], names=["n", "prefix_chars", "middle_chars"])


def draw(doc_id: Column, k: int, seed: str) -> Column:
    """The k-th number below 2^32 that a seed and a document's id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """Per document: n tokens, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate: the percentage of texts that aren't left plain; spm: of those, the percentage whose suffix comes first.
    """
    h = [draw(F.col("doc_id"), k, seed) for k in (1, 2, 3, 4)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h, 1)))
    split = rows.withColumn("c", F.arrow_udf(_measured, _DDL)("text", "h1", "h2"))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cut = split.select("doc_id", "text", form.alias("form"), "c.*")
    one = F.lit(1)
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    part = {"p": F.substring("text", one, p), "m": F.substring("text", p + 1, m), "s": F.substring("text", p + m + 1, F.char_length("text"))}

    def marked_parts(order: str) -> Column:
        return F.concat(*(x for k in order for x in (F.lit(MARKS[k]), part[k])))

    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", marked_parts("spm")).otherwise(marked_parts("psm"))
    sizes = (F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars"))
    return cut.select("doc_id", "n", "form", *sizes, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark has no end that is its own beginning, so its first occurrence is the one put there."""
    size = F.char_length(output)
    last = F.locate(MARKS["m"], output)
    middle = F.substring(output, last + 3, size)

    def parts(second: str) -> tuple[Column, Column]:
        at = F.locate(MARKS[second], output)
        return F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, last - at - 3)

    (prefix, suffix), (suffix_first, prefix_second) = parts("s"), parts("p")
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_second, middle, suffix_first))
