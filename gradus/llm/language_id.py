"""Language ID by hierarchical discrimination: first the family, then the language.

A text is its character sequences of one to ``LONGEST`` bytes, lower-cased, words
apart by one blank, hashed to ``WIDTH`` features. Features are weighted by their
frequency, so that common ones don't drown the others, and a text's evidence grows
with the square root of its length, up to ``ENOUGH`` sequences.

1. A softmax unit over all features predicts the language's family.
2. Within the family, one linear support vector machine for each pair of languages
   votes (squared hinge loss); most votes win, then the sum of margins, then the name.

The score is the family's probability times the mean of the winner's logistic
margins. Families are a parameter; a language that it does not name is a family of
its own. Models are trained on the driver on a bounded sample: at most ``SAMPLE_ROWS``
labelled rows, as many of each language, those with the smallest hash of their id;
whole texts are turned into features in the tasks. All texts are then scored whole
in one narrow pass: sums of weights, in slices, so that memory doesn't follow a long
text's sequences.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so
is every text where nothing could be learned; one language is predicted for all
others if it is the only one; a null id is not held out and teaches nothing; null
languages teach nothing; repeated rows get the same result each; an empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.blocks import Block, blocks
from gradus.llm.common import crc_mod

HELD_OUT = 5
SAMPLE_ROWS = 2_000
LONGEST = 4
WIDTH_BITS = 13
WIDTH = 1 << WIDTH_BITS
ENOUGH = 4_096
#: Languages whose counts are broadcast; of more, one row each is learned from anyway.
BROADCAST_LANGUAGES = 10_000
SLICE = 1 << 18
STEPS = 80
UNKNOWN = "und"

#: Families of some languages by their codes.
FAMILIES = {
    **dict.fromkeys(("de", "en", "nl", "af", "da", "sv", "no", "nb", "nn", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("lt", "lv"), "baltic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "gu", "pa", "ne"), "indic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "ky"), "turkic"),
    **dict.fromkeys(("ar", "he", "mt"), "semitic"),
}

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_HASH = np.uint32(2_654_435_761)


def _stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one blank between words and around each text; where
    each text begins in it."""
    n = len(block.offsets) - 1
    sizes = np.diff(block.offsets)
    out = np.full(len(block.data) + 2 * n, 32, np.uint8)
    at = np.repeat(2 * np.arange(n) + 1, sizes)
    at += np.arange(len(block.data))
    out[at] = _PLAIN[block.data]
    edge = block.offsets[:-1] + 2 * np.arange(n)  # the blank before each text
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[edge] = True
    places = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return out[keep], np.append(places[edge], places[-1])


def _features(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the stream: feature of each sequence, and its text."""
    for lo in range(0, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        piece = data[lo : hi + LONGEST - 1]
        text = np.searchsorted(first, np.arange(lo, lo + len(piece)), "right") - 1
        key = np.zeros(len(piece), np.uint32)
        for n in range(1, LONGEST + 1):
            m = min(hi - lo, len(piece) - n + 1)
            if m <= 0:
                break
            key = key[:m] * np.uint32(257) + piece[n - 1 : n - 1 + m] + np.uint32(n)
            inside = text[:m] == text[n - 1 : n - 1 + m]
            if n == 1:
                inside &= piece[:m] != 32
            else:  # sequences of a blank alone say nothing
                inside &= (piece[:m] != 32) | (piece[1 : 1 + m] != 32)
            mixed = key * _HASH
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - WIDTH_BITS))[inside], text[:m][inside]


def feature_counts(block: Block) -> np.ndarray:
    """Counts of all features, a row for each text (few texts at a time)."""
    n = len(block.offsets) - 1
    out = np.zeros(n * WIDTH, np.int64)
    for feature, text in _features(*_stream(block)):
        out += np.bincount(text * WIDTH + feature, minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def evidence(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """From sums over a text's sequences to what the models see."""
    share = np.sqrt(np.minimum(totals, ENOUGH)) / np.maximum(totals, 1)
    return sums * share[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(x: np.ndarray, slope, n_out: int, penalty: float) -> np.ndarray:
    """Weights after Adam on all rows; ``slope(x @ w)`` is the loss by output."""
    w = np.zeros((x.shape[1], n_out), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = x.T @ (slope(x @ w) / np.float32(len(x))) + penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = 0.05 / (1 + step / 40)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


@dataclass
class Model:
    """``weights``: a column for each family, then one for each pair of languages."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 0), np.float32))

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        n = len(block.offsets) - 1
        sums = np.zeros((n, self.weights.shape[1]))
        totals = np.zeros(n)
        for feature, text in _features(*_stream(block)):
            if len(feature):
                cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                whose = text[cuts]
                if self.weights.shape[1]:
                    sums[whose] += np.add.reduceat(self.weights[feature], cuts, dtype=np.float64)
                totals[whose] += np.diff(np.append(cuts, len(text)))
        return self.decide(evidence(sums, totals))

    def decide(self, z: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(z)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        k = len(self.families)
        chance = _softmax(z[:, :k])
        family = chance.argmax(1)
        names, score = np.empty(n, object), chance[np.arange(n), family]
        column = k
        for f, languages in enumerate(self.members):
            own = np.flatnonzero(family == f)
            pairs = list(combinations(range(len(languages)), 2))
            votes = np.zeros((len(own), len(languages)))
            margins = np.zeros((len(own), len(languages)))
            sure = np.zeros((len(own), len(languages)))
            for p, (a, b) in enumerate(pairs):
                d = z[own, column + p]
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                margins[:, a] += d
                margins[:, b] -= d
                sure[:, a] += 1 / (1 + np.exp(-np.clip(2 * d, -30, 30)))
                sure[:, b] += 1 / (1 + np.exp(np.clip(2 * d, -30, 30)))
            # Most votes, then the largest margins, then the first name.
            top = np.zeros(len(own), int)
            every = np.arange(len(own))
            for i in range(1, len(languages)):
                more = votes[:, i] - votes[every, top]
                wide = margins[:, i] > margins[every, top]
                top = np.where((more > 0) | ((more == 0) & wide), i, top)
            names[own] = np.array(languages, object)[top]
            if pairs:
                score[own] *= sure[every, top] / (len(languages) - 1)
            column += len(pairs)
        return names.tolist(), np.clip(score, 0.0, 1.0)


def train(counts: np.ndarray, languages: list[str], families: Mapping[str, str] = FAMILIES) -> Model:
    """Models from feature counts (a row for each text) and their languages."""
    totals = counts.sum(1).astype(np.float64)
    some = totals > 0
    counts, totals = counts[some], totals[some]
    languages = [x for x, s in zip(languages, some, strict=True) if s]
    if not languages:
        return Model()
    known = sorted(set(languages))
    groups: dict[str, list[str]] = {}
    for x in known:
        groups.setdefault(families.get(x, x), []).append(x)
    names = sorted(groups)
    # A feature's weight: one over the root of its mean share.
    share = (1 / totals).astype(np.float32) @ counts / len(counts)
    scale = np.where(share > 0, 1 / np.sqrt(share + 1e-6), 0).astype(np.float32)
    x = counts * scale  # the only copy: 32 kB for each text
    for i, total in enumerate(totals):
        x[i] *= np.sqrt(min(total, ENOUGH)) / total
    norm = np.float32(np.sqrt(np.mean(np.einsum("ij,ij->i", x, x))))
    x /= norm
    labels = np.array(languages)
    kin = np.array([names.index(families.get(y, y)) for y in languages])
    target = np.eye(len(names), dtype=np.float32)[kin]
    columns = [_descend(x, lambda z: _softmax(z) - target, len(names), 1e-4)]
    for name in names:
        for a, b in combinations(groups[name], 2):
            rows = (labels == a) | (labels == b)
            y = np.where(labels[rows] == a, 1, -1).astype(np.float32)[:, None]
            hinge = lambda z, y=y: -y * np.maximum(0, 1 - y * z)
            columns.append(_descend(x[rows], hinge, 1, 1e-3))
    weights = np.hstack(columns) * scale[:, None] / norm
    return Model(names, [groups[n] for n in names], weights.astype(np.float32))


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(batch.column("text"), ""))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            for block in blocks(_lowered(row)):
                counts = feature_counts(block)[0]
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("lang"),
                        pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                        pa.array([counts[at].astype(np.uint32).tobytes()], pa.binary()),
                    ],
                    ["lang", "features", "counts"],
                )


def learn(
    docs: DataFrame, families: Mapping[str, str] = FAMILIES, sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Models from documents that aren't held out and whose language is known."""
    known = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where(
        F.col("doc_id").isNotNull()
        & F.col("lang").isNotNull()
        & (crc_mod(F.col("doc_id"), HELD_OUT) != 0)
        & _has_letter("text")
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    n_languages = sizes.count()
    if not n_languages:
        return Model()
    each = max(1, sample_rows // n_languages)
    # Hashes are even, so the smallest lie below a bound that follows the rows: about
    # twice those wanted are left before any language's rows meet.
    if n_languages <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    slim = known.select(
        "doc_id", "lang", rank.alias("rank"), F.xxhash64("text").alias("hash")
    ).join(sizes, "lang")
    few = slim.where(F.col("rank").cast("double") * F.col("rows") <= float((2 * each + 100) << 40))
    order = Window.partitionBy("lang").orderBy("rank", "doc_id", "hash")
    chosen = (
        few.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= each)
        .select("doc_id", "lang", "hash")
        .distinct()
        .orderBy("doc_id", "lang", "hash")
        .limit(sample_rows)
    )
    key = ["doc_id", "lang", "hash"]
    texts = known.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), key)
    # A row that is repeated in the table counts once: sample_rows texts at most.
    sample = texts.dropDuplicates(key).select("lang", "text").mapInArrow(
        _sample_rows, "lang string, features binary, counts binary"
    )
    rows = sample.orderBy("lang", "features", "counts").collect()
    counts = np.zeros((len(rows), WIDTH), np.float32)
    for i, row in enumerate(rows):
        counts[i, np.frombuffer(row["features"], np.uint16)] = np.frombuffer(row["counts"], np.uint32)
    return train(counts, [r["lang"] for r in rows], families)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 32 kB for each column
    slim = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), _has_letter("text").alias("lettered")
    )
    schema = T.StructType(
        [
            slim.schema["doc_id"],
            T.StructField("lettered", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(_lowered(batch), SLICE):
                names, score = held.value.predict(block)
                part = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("lettered"),
                        pa.array(names, pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    schema.names,
                )

    return slim.mapInArrow(run, schema).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )
