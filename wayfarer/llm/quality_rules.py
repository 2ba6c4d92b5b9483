"""Quality rules: base limits, then a learned decision list.

Sequential covering learns the list from labelled statistics: each rule grows, condition by condition, on
two thirds of the rows not yet covered, is pruned on the other third and stays if it is precise enough
there. The list becomes one ordered Spark conditional expression. It is fitted on at most `sample`
labelled rows, those of the least hash of doc_id; everything else covers all rows. Rules of both verdicts
are learned, so the first that holds decides. Equal words, windows and lines are told by 128-bit hashes.

Defined cases: null text has no words, so the base rejects it; labels without both kinds give an empty
list, which keeps what the base keeps; null labels and labels of unknown documents are left out; a
doc_id with several labels takes the worst, and with several texts one of them to learn from; repeated
rows are judged each; an empty table gives an empty result; further columns are ignored. A text is measured
whole, at some 150 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm import textnum as tn
from wayfarer.llm.common import texts, whole_rows

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
DIGITS = np.isin(np.arange(256), list(b"0123456789"))
CAPITALS = np.isin(np.arange(256), list(range(65, 91)))
MARKS = np.isin(np.arange(256), list(b".,;:!?"))
NEWLINE = np.arange(256) == 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_marks", "n_kinds")
FEATURES = ("n_words", "mean_chars", "symbols", "dup_lines", "repeats", "digits", "capitals", "marks", "kinds", "words_a_line")
Conditions = list[tuple[str, str, float]]
Rule = tuple[bool, Conditions]  # if what the conditions cover stays


Keys = tuple[np.ndarray, np.ndarray]


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Keys:
    """128 bits for each span."""
    return tn.hashes(data, start, end, 1), tn.hashes(data, start, end, 2)


def _again(keys: Keys, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seen_twice within each group."""
    own = tn.mix(group.astype(np.uint64) + tn.BASE)
    return tn.seen_twice(*(tn.mix(k + own) for k in keys))


def _measures(part: pa.RecordBatch) -> list[np.ndarray]:
    data, at = tn.raw(part.column("text"))
    start, end, first = tn.words(data, at)
    n, row = np.diff(first), np.repeat(np.arange(len(part)), np.diff(first))
    h = _keys(data, start, end)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][at])

    chars = per_row(((data & 0xC0) != 0x80) & ~tn.SPACES[data])
    # lines: a row's parts between newlines
    cuts = np.flatnonzero(NEWLINE[data])
    line_start = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")
    line_row = np.repeat(np.arange(len(part)), per_row(NEWLINE[data]) + 1)
    line_end = np.sort(np.concatenate([at[1:], cuts]), kind="stable")
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    kept = np.flatnonzero(with_word)
    _, once = _again(_keys(data, line_start[kept], line_end[kept]), line_row[kept])
    dup_lines = np.bincount(line_row[kept][~once], minlength=len(part))
    lines = np.bincount(line_row[kept], minlength=len(part))
    repeat_words = np.zeros(len(part), np.int64)
    if len(row) > 2:
        i = np.flatnonzero(row[:-2] == row[2:])
        twice, _ = _again(tuple(tn.chained(x, i, 3) for x in h), row[i])
        hit = np.zeros(len(row), bool)
        for k in range(3):
            hit[i[twice] + k] = True
        repeat_words = np.bincount(row[hit], minlength=len(part))
    _, kind = _again(h, row)
    return [n, chars, per_row(SYMBOLS[data]), dup_lines, repeat_words, lines, per_row(DIGITS[data]), per_row(CAPITALS[data]), per_row(MARKS[data]), np.bincount(row[kind], minlength=len(part))]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tn.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(x) for x in ("doc_id", "k1", "k2")] + [pa.array(x.astype(np.int64)) for x in _measures(part)], names=["doc_id", "k1", "k2", *COUNTS])


def beside(docs: DataFrame) -> DataFrame:
    """Each row of docs, whole in the column row, with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tn.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row")] + [pa.array(x.astype(np.int64)) for x in _measures(part)], names=["row", *COUNTS])

    rows = whole_rows(docs)
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *(T.StructField(x, T.LongType()) for x in COUNTS)]))


def statistics(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_measured, "doc_id long, k1 long, k2 long, " + ", ".join(f"{x} long" for x in COUNTS))


def features() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_chars": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words,
        "digits": F.col("n_digits") / chars, "capitals": F.col("n_capitals") / chars, "marks": F.col("n_marks") / words, "kinds": F.col("n_kinds") / words, "words_a_line": F.col("n_words") / lines,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def covers(rule: Conditions, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, limit in rule:
        column = x[:, FEATURES.index(name)]
        out &= column <= limit if sign == "<=" else column > limit
    return out


def _grown(x: np.ndarray, bad: np.ndarray, most: int, steps: int) -> Conditions:
    """Conditions that cover bad rows and few others."""
    rule, live = [], np.ones(len(x), bool)
    while len(rule) < most and live.any() and not bad[live].all():
        before, best = np.log2(max(bad[live].mean(), 1e-12)), (0.0, None)
        for j, name in enumerate(FEATURES):
            values = np.sort(x[live, j])
            for limit in np.unique(values[np.linspace(0, len(values) - 1, steps).astype(int)]):
                for sign in ("<=", ">"):
                    inside = live & (x[:, j] <= limit if sign == "<=" else x[:, j] > limit)
                    hits = int(bad[inside].sum())
                    gain = hits * (np.log2(hits / inside.sum()) - before) if hits else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, sign, float(limit)))
        if best[1] is None:
            break
        name, sign, limit = best[1]
        column = x[live, FEATURES.index(name)]
        above = column[column > limit]
        # halfway to the next value seen, so that neither side lies on the limit
        limit = (limit + float(above.min())) / 2 if len(above) else limit
        rule.append((name, sign, limit))
        live &= covers(rule[-1:], x)
    return rule


def _pruned(rule: Conditions, x: np.ndarray, target: np.ndarray) -> tuple[Conditions, int, float]:
    """The rule without last conditions that rows it wasn't grown on don't ask for; what it hits there, and how precisely."""

    def hits(r: Conditions) -> tuple[int, int]:
        hit = covers(r, x)
        return int(target[hit].sum()), int((~target[hit]).sum())

    def worth(r: Conditions) -> float:
        p, n = hits(r)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    p, n = hits(rule) if rule else (0, 0)
    return rule, p, p / (p + n) if p + n else 0.0


def learned_list(x: np.ndarray, bad: np.ndarray, precise: float = 0.95, least: int = 5, most: int = 4, steps: int = 129, rules: int = 16) -> list[Rule]:
    """Rules in order, each learned on the rows that none before it covers; rows are taken as they come, every third to prune on.

    In each round a rejecting and a keeping rule are grown and pruned; of those precise enough, on the rows
    to prune on and on all, the more precise one joins the list (the rejecting one of two alike).
    """
    out: list[Rule] = []
    left = np.ones(len(x), bool)
    for _ in range(rules):
        at = np.flatnonzero(left)
        grow, prune = at[np.arange(len(at)) % 3 != 0], at[np.arange(len(at)) % 3 == 0]
        if bad[grow].sum() < least or (~bad[grow]).sum() < least:
            break
        found: list[tuple[float, bool, Conditions]] = []
        for keeps in (False, True):
            target = bad != keeps
            rule, hit, precision = _pruned(_grown(x[grow], target[grow], most, steps), x[prune], target[prune])
            if rule and hit >= least and min(precision, target[left & covers(rule, x)].mean()) >= precise:
                found.append((precision, not keeps, rule))
        if not found:
            break
        _, rejects, rule = max(found, key=lambda f: f[:2])
        out.append((not rejects, rule))
        left &= ~covers(rule, x)
    return out


def decided(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """If each row stays, by the first rule that covers it; rows that none covers stay."""
    out, left = np.ones(len(x), bool), np.ones(len(x), bool)
    for keeps, rule in rules:
        hit = left & covers(rule, x)
        out[hit] = keeps
        left &= ~hit
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds decides, and what none covers stays."""
    columns, out = features(), None
    for keeps, rule in rules:
        test = F.lit(True)
        for name, sign, limit in rule:
            test &= columns[name] <= limit if sign == "<=" else columns[name] > limit
        out = F.when(test, F.lit(keeps)) if out is None else out.when(test, F.lit(keeps))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    drawn = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(drawn.select(F.col("doc_id").alias("label_id"))), F.col("doc_id") == F.col("label_id"), "left_semi"))
    # one row of each doc_id, so that the sample bounds what comes to the driver
    measured = F.struct("k1", "k2", *(c.alias(f"f_{k}") for k, c in features().items()))
    rows = rows.where(~base_failed()).groupBy("doc_id").agg(F.min(measured).alias("f"))
    table = rows.join(F.broadcast(drawn), "doc_id").select("h", "doc_id", "quality", "f.*").orderBy("h", "doc_id").toPandas()
    x = table[[f"f_{k}" for k in FEATURES]].to_numpy(float).reshape(-1, len(FEATURES))
    return learned_list(x, (table["quality"] == 0).to_numpy(bool))


def judged(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    rules = fit(docs, labels, sample)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """docs without the rejected rows. Each row goes with its own statistics, so no text is shuffled."""
    rules = fit(docs, labels, sample)
    return beside(docs).where(~base_failed() & verdict(rules)).select("row.*")
