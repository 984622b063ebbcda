"""Toxicity: misspelled lexicon terms, weighed by the words around them.

``learn`` finds a lexicon in labelled texts: words and beginnings of words that
toxic texts hold and others don't. The terms form a trie. A word of a text is read
by the Levenshtein automaton of that word while the trie is walked, so all terms
within one edit are found at once; a branch is left as soon as no state of the
automaton is alive. Terms of fewer than ``FUZZY_FROM`` characters, and those that few
texts vouch for, must be exact. A hit weighs as much as its term's log-odds.

A hit counts as quoted if, among the ``CONTEXT`` words before it, a quotation opens
that closes among the same number after it, or a word of reported speech stands just
before the quotation. Exact and misspelled hits, quoted or not, have weights of their
own; they are fitted to the sample but drawn towards a prior in which quotation
counts less than abuse.

Learning takes at most ``SAMPLE_ROWS`` labelled texts that aren't held out. Term
counts of toxic and other texts are summed, joined and filtered by share in Spark;
every term that passes comes to the driver, so their number is bounded by the sample
alone. Scoring is one narrow pass over whole texts.

Defined results: null and empty texts have no hits and get the lowest score; labels
that are null or without text teach nothing; without toxic labels the lexicon is
empty; null ids and repeated rows are kept; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.blocks import Block, blocks, range_names
from gradus.llm.common import crc_mod, stored

SAMPLE_ROWS = 16_000
HELD_OUT, HELD_AT = 3, 1
#: Terms come from beginnings of so many characters, and whole words.
PREFIXES = range(4, 13)
#: A term is in so many toxic texts at least, and toxic texts are such a share.
LEAST_TEXTS, LEAST_SHARE = 4, 0.95
#: Slots by which terms of other texts that no toxic one has are left out early.
SLOTS = 1 << 24
FUZZY_FROM, FUZZY_STRENGTH = 5, 5.5
#: Log-odds that count as one hit, and the most hits that count.
UNIT, MOST = 5.0, 6.0
CONTEXT = 8
CUT = 0.7
#: Words whose hits a task remembers; then it starts anew.
REMEMBERED = 1_000_000

#: Weights before learning: exact, exact quoted, misspelled, misspelled quoted, bias.
PRIOR = np.array([3.0, 0.8, 2.0, 0.5, -3.5])

_OPEN, _CLOSE = "\"'“”„«»‘", "\"'”“»«’"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…—–¡¿"
#: Words of reported speech, in the languages of the texts.
_SPEECH = frozenset(
    "said says wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
)


def plain(word: str) -> str:
    return word.lower().strip(_EDGE)


# A term's end in the trie: True if it is the beginning of words.
_END = ""


Term = tuple[str, bool, float]


def build_trie(terms: list[Term]) -> dict:
    root: dict = {}
    for term, beginning, strength in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[_END] = (beginning, strength)
    return root


def fuzzy(term: Term) -> bool:
    """May the term be misspelled?"""
    return len(term[0]) >= FUZZY_FROM and term[2] >= FUZZY_STRENGTH


class Automaton:
    """Levenshtein automaton of one word, for one edit. A state is two sets of
    places in the word, as bits: those reached without an edit, and with one."""

    def __init__(self, word: str) -> None:
        self.last = 1 << len(word)
        self.all = (self.last << 1) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def start(self) -> tuple[int, int]:
        return 1, 3 & self.all

    def step(self, state: tuple[int, int], c: str) -> tuple[int, int]:
        none, one = state
        here = self.at.get(c, 0)
        kept = (none & here) << 1
        # The same character; another; one that the word lacks; one it has too many.
        edited = (one & here) << 1 | none << 1 | none | kept << 1
        return kept & self.all, edited & self.all


class Lexicon:
    """Terms as tries: all of them, and those that may be misspelled."""

    def __init__(self, terms: list[Term]) -> None:
        self.exact = build_trie(terms)
        loose = [t for t in terms if fuzzy(t)]
        self.misspelled = build_trie(loose)
        # One edit leaves a term's first or second half as it is: without either a
        # word needs no automaton.
        self.first: dict[int, set[str]] = {}
        self.second: dict[tuple[int, int], set[str]] = {}
        for term, _, _ in loose:
            half = len(term) // 2
            self.first.setdefault(half, set()).add(term[:half])
            self.second.setdefault((half, len(term) - half), set()).add(term[half:])

    def near(self, word: str) -> bool:
        for half, starts in self.first.items():
            if word[:half] in starts:
                return True
        for (half, n), ends in self.second.items():
            for at in (half - 1, half, half + 1):
                if word[at : at + n] in ends:
                    return True
        return False

    def best_hit(self, word: str) -> tuple[int, float] | None:
        """Edits between the word and its nearest term, and the term's strength;
        None beyond one edit. The strongest of equally near terms counts."""
        node, best = self.exact, 0.0
        for i, c in enumerate(word, 1):
            if (node := node.get(c)) is None:
                break
            if _END in node:
                beginning, strength = node[_END]
                if beginning or i == len(word):
                    best = max(best, strength)
        if best:
            return 0, best
        if not self.near(word):
            return None
        machine = Automaton(word)
        stack = [(self.misspelled, machine.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == _END:
                    beginning, strength = child
                    if state[1] & (machine.all if beginning else machine.last):
                        best = max(best, strength)
                else:
                    after = machine.step(state, c)
                    if after[0] or after[1]:
                        stack.append((child, after))
        return (1, best) if best else None


def quoted(before: list[str], word: str, after: list[str]) -> bool:
    """Does a quotation open before (or at) the word and close after (or at) it?"""
    opens = [i for i, w in enumerate([*before, word]) if w[0] in _OPEN]
    closes = any(w.rstrip(".,;:!?")[-1:] in _CLOSE for w in [word, *after] if w)
    if opens and closes:
        return True
    said = {plain(w) for w in before[-2:]}
    return bool(said & _SPEECH) and bool(opens)


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray

    def describe(self) -> str:
        return f"{len(self.terms)} terms {self.terms[:40]}, weights {self.weights}"

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:4] + self.weights[4]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Hits:
    """Counts the hits of texts; remembers words from block to block."""

    def __init__(self, terms: list[Term]) -> None:
        self.lexicon = Lexicon(terms)
        self.known: dict[int, tuple[int, float] | None] = {}

    def _found(self, block: Block, starts: np.ndarray, ends: np.ndarray):
        """Edits (-1: no hit) and strength of each word's term."""
        names = range_names(block.data, starts, ends)
        distinct, at, back = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        edits, strength = np.full(len(distinct), -1), np.zeros(len(distinct))
        for i, (name, w) in enumerate(zip(distinct.tolist(), at.tolist(), strict=True)):
            if name not in self.known:
                word = plain(block.data[starts[w] : ends[w]].tobytes().decode())
                self.known[name] = self.lexicon.best_hit(word) if len(word) >= 3 else None
            if hit := self.known[name]:
                edits[i], strength[i] = hit
        return edits[back], strength[back]

    def features(self, block: Block) -> np.ndarray:
        """Sums of strengths of each text's hits: exact, exact quoted, misspelled,
        misspelled quoted; then how many there are of each."""
        starts, ends, first = block.words()
        out = np.zeros((block.hi - block.lo, 8))
        if not len(starts):
            return out
        edits, strength = self._found(block, starts, ends)
        for i in np.flatnonzero(edits >= 0):
            text = int(np.searchsorted(first, i, "right")) - 1
            lo, hi = max(first[text], i - CONTEXT), min(first[text + 1], i + CONTEXT + 1)
            near = [
                block.data[a:b].tobytes().decode()
                for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)
            ]
            k = i - lo
            kind = 2 * (edits[i] > 0) + quoted(near[:k], near[k], near[k + 1 :])
            out[text, kind] += strength[i]
            out[text, 4 + kind] += 1
        out[:, :4] = np.minimum(out[:, :4] / UNIT, MOST)
        return out


def fit(x: np.ndarray, toxic: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the prior."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(5)
        w = w - np.linalg.solve(curve, slope)
    w[:4] = np.maximum(w[:4], 0)  # a hit never speaks against
    w[1], w[3] = min(w[1], w[0]), min(w[3], w[2])  # quotation never counts more
    return w


def _terms_of(text: str | None) -> set[tuple[str, bool]]:
    words = {plain(w) for w in (text or "").split()}
    found = {(w, False) for w in words if len(w) >= 3}
    return found | {(w[:n], True) for w in words for n in PREFIXES if len(w) >= n}


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) % SLOTS


def _count_terms(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """In how many texts each term is (of those whose slot is wanted, if these are
    given)."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch["text"].to_pylist():
            found = _terms_of(text)
            if wanted is not None:
                slots = wanted.value
                found = {t for t in found if slots[_slot(t[0])]}
            counts.update(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t for t, _ in counts], pa.string()),
                pa.array([b for _, b in counts], pa.bool_()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["term", "beginning", "texts"],
        )


def _term_counts(texts: DataFrame, wanted=None) -> DataFrame:
    rows = texts.select("text").mapInArrow(
        lambda it: _count_terms(it, wanted), "term string, beginning boolean, texts bigint"
    )
    return rows.groupBy("term", "beginning").agg(F.sum("texts").alias("texts"))


def choose_terms(
    rows: list[tuple[str, bool, int, int]], odds: float = 1.0
) -> list[Term]:
    """Of the beginnings of one another, those that say as much in more characters;
    whole words only where no beginning stands for them. ``odds``: of other texts
    to toxic ones."""
    stems = {t: n for t, beginning, n, _ in rows if beginning}
    names, place = sorted(stems), {t: i for i, t in enumerate(stems)}
    chosen: set[tuple[str, bool]] = set()
    for root in sorted(stems, key=lambda t: (len(t), t)):
        if any(root[:n] in stems for n in PREFIXES if n < len(root)):
            continue
        best = root
        under = names[bisect_left(names, root) : bisect_left(names, root + chr(0x10FFFF))]
        for longer in sorted(under, key=lambda t: (len(t), place[t])):
            if stems[longer] >= 0.95 * stems[root]:
                best = longer
        chosen.add((best, True))
    for word, beginning, _, _ in rows:
        if not beginning and not any(word[:n] in stems for n in PREFIXES if n <= len(word)):
            chosen.add((word, False))
    held = {(t, beginning): (a, b) for t, beginning, a, b in rows}
    return sorted(
        (*key, float(np.log(odds * (held[key][0] + 0.5) / (held[key][1] + 0.5))))
        for key in chosen
    )


def passing_terms(sample: DataFrame) -> list[tuple[str, bool, int, int]]:
    """Every term that enough toxic texts vouch for: ``term, beginning``, toxic texts
    and others that have it. ``sample``: ``text, toxic``."""
    toxic = stored(
        _term_counts(sample.where("toxic")).where(F.col("texts") >= LEAST_TEXTS), "toxic_terms"
    )
    slots = np.zeros(SLOTS, bool)
    held = toxic.select(F.pmod(F.crc32("term"), F.lit(SLOTS)).alias("slot")).distinct()
    slots[[r.slot for r in held.collect()]] = True
    wanted = sample.sparkSession.sparkContext.broadcast(slots)
    other = _term_counts(sample.where("NOT toxic"), wanted).withColumnRenamed("texts", "others")
    others = F.coalesce("others", F.lit(0))
    rows = (
        toxic.join(other, ["term", "beginning"], "left")
        .select("term", "beginning", "texts", others.alias("others"))
        .where(F.col("texts") >= F.lit(LEAST_SHARE) * (F.col("texts") + F.col("others")))
        .orderBy(F.desc("texts"), "term", "beginning")
    )
    return [tuple(r) for r in rows.collect()]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    chosen = (
        labels.select("doc_id", F.col("toxic").alias("_t"))
        .where("doc_id IS NOT NULL AND _t IS NOT NULL")
        .where(crc_mod(F.col("doc_id"), HELD_OUT) != HELD_AT)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_t")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers; the texts stay in Spark.
    sample = stored(
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", (F.col("_t") != 0).alias("toxic")),
        "labelled",
    )
    rows = passing_terms(sample)
    size = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    terms = choose_terms(rows, (size[1] + 1) / (size[0] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(terms)
        for batch in batches:
            for block in blocks(batch.column("text")):
                toxic = batch.column("toxic").slice(block.lo, block.hi - block.lo)
                columns = [pa.array(c) for c in hits.features(block)[:, :4].T]
                yield pa.RecordBatch.from_arrays([toxic, *columns], ["toxic", *"abcd"])

    found = sample.select("text", "toxic").mapInArrow(
        run, "toxic boolean, a double, b double, c double, d double"
    )
    # Few distinct rows; sorted, so that sums come out the same each time.
    table = found.groupBy(*"abcd", "toxic").count().orderBy(*"abcd", "toxic").collect()
    x = np.array([[r[c] for c in "abcd"] for r in table for _ in range(r["count"])]).reshape(-1, 4)
    y = np.array([float(r["toxic"]) for r in table for _ in range(r["count"])])
    return Model(terms, fit(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and counts of hits, for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["score", "n_exact", "n_exact_quoted", "n_misspelled", "n_misspelled_quoted"]
    kinds = [T.DoubleType()] + [T.LongType()] * 4
    schema = T.StructType(
        [slim.schema["doc_id"]]
        + [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(held.value.terms)
        for batch in batches:
            for block in blocks(batch.column("text")):
                x = hits.features(block)
                counts = x[:, 4:].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.lo, block.hi - block.lo),
                        pa.array(held.value.score(x[:, :4])),
                        *(pa.array(c) for c in counts.T),
                    ],
                    schema.names,
                )

    out = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == HELD_AT, F.lit(False))
    return slim.mapInArrow(run, schema).select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        *names[1:],
    )
