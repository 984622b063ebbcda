"""Quality rules as a learned decision list.

``text_stats`` counts plain statistics of every whole text in one narrow pass.
``learn_rules`` covers the bad texts of a labelled sample one rule at a time: a
rule is a conjunction of thresholds that grows on two thirds of the sample by
information gain and is pruned on the rest; texts it covers are taken out before
the next rule is sought. A list has at most ``MAX_RULES`` rules of at most 4
thresholds each; what they leave uncovered is kept. ``verdict`` turns the ordered rules into one conditional
expression of Spark.

Defined results: a null or empty text has zero of everything; a null label or a
label without a document teaches nothing; without bad labels the list is empty and
keeps all. Only the id column and the statistics are returned by ``text_stats``, so
extra columns can't clash; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.blocks import SPACE, Block, blocks, owners, range_names, windows

#: Most labelled rows that a list is learned from (those with the smallest hash).
SAMPLE_ROWS = 20_000
#: A rule is kept if so much of what it covers is bad, in growing and pruning parts.
MIN_PRECISION = 0.9
MAX_RULES = 24
REPEAT_WORDS = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_distinct_words",
)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
    }


def _line_counts(block: Block, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those equal to an earlier one."""
    data = block.data
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, block.offsets)
    cuts = cuts[cuts <= len(data)]
    starts, ends = cuts[:-1], cuts[1:].copy()
    ends -= (ends > starts) & (data[ends - 1] == 10) if len(ends) else 0
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    text = np.searchsorted(block.offsets, starts, "right") - 1
    lines = np.bincount(text, minlength=n_texts)
    names = range_names(data, starts, ends, 3)
    order = np.lexsort((names, text))
    again = np.zeros(len(order), bool)
    again[1:] = (names[order][1:] == names[order][:-1]) & (
        text[order][1:] == text[order][:-1]
    )
    return lines, np.bincount(text[order][again], minlength=n_texts)


def _first_seen(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by (text, name), and which entries begin a new name."""
    order = np.lexsort((names, text))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (
        text[order][1:] != text[order][:-1]
    )
    return order, new


def block_counts(block: Block) -> dict[str, np.ndarray]:
    n = block.hi - block.lo
    data = block.data
    starts, ends, first = block.words()
    names = range_names(data, starts, ends)
    text = owners(first)
    solid = ~SPACE[data]
    out = {
        "n_words": np.diff(first),
        "word_chars": block.per_text(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(_SYMBOL[data]),
        "n_upper": block.per_text((data >= 65) & (data <= 90)),
        "n_digits": block.per_text((data >= 48) & (data <= 57)),
        "n_marks": block.per_text(_MARK[data]),
    }
    out["n_lines"], out["n_dup_lines"] = _line_counts(block, n)
    order, new = _first_seen(names, text)
    out["n_distinct_words"] = np.bincount(text[order][new], minlength=n)
    # Words in windows that the text holds twice or more.
    keys, at = windows(names, first, REPEAT_WORDS)
    order, new = _first_seen(keys, text[at])
    twice = ~new
    twice[:-1] |= ~new[1:]
    covered = np.zeros(len(names) + 1, np.int64)
    hits = at[order[twice]]
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + REPEAT_WORDS, -1)
    inside = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(text[inside], minlength=n)
    return out


def text_stats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``COUNTS`` of every row. No shuffle."""
    slim = docs.select(F.col(id_col), F.col(text).cast("string").alias("_text"))
    schema = T.StructType(
        [slim.schema[0]] + [T.StructField(c, T.LongType()) for c in COUNTS]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                got = block_counts(block)
                ids = batch.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(got[c], pa.int64()) for c in COUNTS)],
                    [id_col, *COUNTS],
                )

    return slim.mapInArrow(count, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.bound if self.above else v <= self.bound

    def column(self) -> Column:
        v = features()[self.feature]
        return v >= F.lit(self.bound) if self.above else v <= F.lit(self.bound)


Rule = tuple[Test, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _candidates(x: dict[str, np.ndarray]) -> list[Test]:
    """Thresholds half way between neighbouring quantiles of each feature."""
    out = []
    for name, v in x.items():
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bound = float((a + b) / 2)
            out += [Test(name, True, bound), Test(name, False, bound)]
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, tests, masks) -> Rule:
    """Add the threshold of the largest information gain until only bad texts are
    left, or none helps."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while (~bad & inside).any() and len(rule) < 4:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        p = (masks & (bad & inside)).sum(1)
        n = (masks & (~bad & inside)).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
        gain = np.where(p > 0, gain, -1.0)
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        rule.append(tests[best])
        inside &= masks[best]
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best share of bad texts beyond good."""

    def worth(r: Rule) -> float:
        hit = _holds(r, x, len(bad))
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[: k + 1] for k in range(len(rule))), key=worth, default=rule)


def cover(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Sequential covering of the bad rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    tests = _candidates(x) if len(bad) else []
    while (bad & left).any() and len(rules) < MAX_RULES:
        g, h = left & ~prune_part, left & prune_part
        xg = {k: v[g] for k, v in x.items()}
        masks = np.array([t.holds(xg) for t in tests])
        rule = _grow(xg, bad[g], tests, masks) if len(tests) and bad[g].any() else ()
        if not rule:
            break
        rule = _prune(rule, {k: v[h] for k, v in x.items()}, bad[h])
        hit = _holds(rule, x, len(bad)) & left
        if not hit.any() or (bad & hit).sum() < MIN_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Decision list from at most ``sample_rows`` rows with a label. The labels are
    chosen first, so that only their documents are counted."""
    chosen = (
        labels.select("doc_id", F.col("quality").alias("_q"))
        .where("doc_id IS NOT NULL AND _q IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_q")
        .limit(sample_rows)
    )
    # At most sample_rows slim rows: small enough to send to every executor.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    known = known.select(
        F.struct("doc_id", "_q").alias("key"), F.col("text").alias("text")
    )
    stats = text_stats(known, "key")
    names = list(features())
    rows = (
        stats.select("key.*", *(c.alias(n) for n, c in features().items()))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_q", *names)
        .limit(sample_rows)
        .collect()
    )
    x = {n: np.array([r[n] for r in rows], float) for n in names}
    bad = np.array([r["_q"] == 0 for r in rows], bool)
    return cover(x, bad)


def verdict(rules: list[Rule]) -> Column:
    """True to keep; the first rule that fits rejects."""
    out = F.lit(True)
    for rule in reversed(rules):
        fits = F.lit(True)
        for test in rule:
            fits = fits & test.column()
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (
        100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    )


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, counts, ``base_failed`` and ``kept`` of every row."""
    return text_stats(docs).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that are kept, with all their columns. The counts stand in a column
    beside them for the time of the pass, so nothing is joined or shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select(
        F.struct(
            *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))
        ).alias("row"),
        F.col("text"),
    )
    judged = text_stats(held, "row").where(~base_failed() & verdict(rules))
    return judged.select(
        *(F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True))
    )
