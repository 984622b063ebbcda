"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks that overlap, so that the whole text is
covered; chunks are made a few hundred at a time, so long texts take no more memory. Each byte has a learned vector; learned filters run over ``WIDTH`` bytes;
the largest response in a chunk counts. A text is the largest and the mean response
of its chunks, combined by a logistic unit into one probability.

For scoring, vectors and filters are folded into one table per place in the filter,
so a filter is a sum of table rows. The network is trained on the driver on a bounded
sample: ``SAMPLE_ROWS`` labelled texts, and of a text longer than ``SAMPLE_BYTES`` bytes
``SAMPLE_PIECES`` pieces, spread evenly from its beginning to its end. Every text is
scored whole, in the tasks, without a shuffle.

Defined results: null and empty texts are one chunk of padding; labels that are null
or have no text teach nothing; without labels of both classes the score is the share
of good labels, or 0.5 with none; null ids and repeated rows are kept; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.blocks import blocks
from gradus.llm.common import crc_mod

SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 16_384
SAMPLE_PIECES = 16
CHUNK = 256
STEP = 192
WIDTH = 5
FILTERS = 12
VECTOR = 8
EPOCHS = 5
HELD_OUT = 5
CUT = 0.3


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many chunks each text has, summed up, and the text of each chunk."""
    sizes = np.diff(offsets)
    rows = np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 0) // STEP))
    first = np.concatenate([[0], np.cumsum(rows)])
    return first, np.repeat(np.arange(len(rows)), rows)


def chunk_rows(
    data: np.ndarray, offsets: np.ndarray, first: np.ndarray, text: np.ndarray, lo: int, hi: int
) -> np.ndarray:
    """Chunks ``lo`` to ``hi``, one row each. Rows are ``CHUNK + WIDTH - 1`` bytes and
    don't reach into the next text."""
    text = text[lo:hi]
    start = offsets[:-1][text] + STEP * (np.arange(lo, lo + len(text)) - first[:-1][text])
    at = start[:, None] + np.arange(CHUNK + WIDTH - 1)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    inside = at < offsets[1:][text][:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, and each text's first row."""
    first, text = chunk_starts(offsets)
    return chunk_rows(data, offsets, first, text, 0, len(text)), first


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    PARTS = ("vectors", "filters", "shift", "weights", "bias")

    def tables(self) -> np.ndarray:
        return np.einsum("bv,wvf->wbf", self.vectors, self.filters).astype(np.float32)

    def responses(self, tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each filter at each byte of each chunk, before the threshold."""
        out = tables[0][rows[:, :CHUNK]]
        for w in range(1, WIDTH):
            out += tables[w][rows[:, w : w + CHUNK]]
        return out

    def pooled(self, peaks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts from the chunks' peaks."""
        live = np.maximum(peaks + self.shift, 0)
        largest = np.maximum.reduceat(live, first[:-1])
        mean = np.add.reduceat(live, first[:-1]) / np.diff(first)[:, None]
        return np.hstack([largest, mean])

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features.astype(np.float64) @ self.weights.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray, rows_at_once: int = 512) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        tables = self.tables()
        first, text = chunk_starts(offsets)
        peaks = np.concatenate(
            [
                self.responses(
                    tables, chunk_rows(data, offsets, first, text, i, i + rows_at_once)
                ).max(1)
                for i in range(0, len(text), rows_at_once)
            ]
        )
        return self.probability(self.pooled(peaks, first))

    def gradients(self, rows: np.ndarray, first: np.ndarray, good: np.ndarray) -> dict:
        """Of the mean log loss. Only the peak of each chunk has a part in it."""
        response = self.responses(self.tables(), rows)
        where = response.argmax(1)
        peaks = np.take_along_axis(response, where[:, None, :], 1)[:, 0]
        live = np.maximum(peaks + self.shift, 0)
        features = self.pooled(peaks, first)
        error = ((self.probability(features) - good) / len(good)).astype(np.float32)
        text = np.repeat(np.arange(len(good)), np.diff(first))
        by_max, by_mean = self.weights[:FILTERS], self.weights[FILTERS:]
        top = live >= features[text, :FILTERS]
        share = top / np.maximum(np.add.reduceat(top, first[:-1]), 1)[text]
        slope = error[text][:, None] * (
            by_max * share + by_mean / np.diff(first)[text][:, None]
        )
        slope = np.where(peaks + self.shift > 0, slope, 0).astype(np.float32)
        by_table = np.zeros((WIDTH, 256, FILTERS), np.float32)
        chunk = np.arange(len(rows))[:, None]
        column = np.broadcast_to(np.arange(FILTERS), where.shape)
        for w in range(WIDTH):
            np.add.at(by_table[w], (rows[chunk, where + w], column), slope)
        return {
            "vectors": np.einsum("wbf,wvf->bv", by_table, self.filters),
            "filters": np.einsum("bv,wbf->wvf", self.vectors, by_table),
            "shift": slope.sum(0),
            "weights": features.T @ error + 1e-4 * self.weights,
            "bias": error.sum(keepdims=True),
        }


def train(texts: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over shuffled batches of texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    share = float(np.mean(good))
    net.bias[0] = np.log(share / (1 - share))
    moments = {p: [np.zeros_like(getattr(net, p)) for _ in range(2)] for p in net.PARTS}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.02 / (1 + epoch)
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            data = np.frombuffer(b"".join(texts[j] for j in batch), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[j]) for j in batch])])
            slopes = net.gradients(*chunked(data, offsets), good[batch])
            step += 1
            for part, (m, v) in moments.items():
                g = slopes[part]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                getattr(net, part)[...] -= size * m / (np.sqrt(v) + 1e-8)
    return net


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.value)


def sampled(text) -> Column:
    """The text, or of one longer than ``SAMPLE_BYTES`` its pieces one after another."""
    raw = text.cast("binary")
    size = SAMPLE_BYTES // SAMPLE_PIECES
    gap = (F.octet_length(text) - size).cast("double") / (SAMPLE_PIECES - 1)
    pieces = [
        F.substr(raw, F.floor(gap * i).cast("int") + 1, F.lit(size)) for i in range(SAMPLE_PIECES)
    ]
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, raw).otherwise(F.concat(*pieces))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """A network from labelled rows that aren't held out."""
    chosen = (
        labels.select("doc_id", F.col("quality").alias("_q"))
        .where("doc_id IS NOT NULL AND _q IS NOT NULL")
        .where(crc_mod(F.col("doc_id"), HELD_OUT) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_q")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers.
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "_q", sampled(F.col("text")).alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_q", "text")
        .limit(sample_rows)
        .select("text", "_q")
        .collect()
    )
    good = np.array([r["_q"] != 0 for r in rows], np.float32)
    if not len(good) or good.min() == good.max():
        return Constant(float(good.mean()) if len(good) else 0.5)
    return train([bytes(r["text"]) for r in rows], good)


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 10 kB
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 18):
                ids = batch.column("doc_id").slice(block.lo, block.hi - block.lo)
                got = held.value.score(block.data, block.offsets)
                yield pa.RecordBatch.from_arrays([ids, pa.array(got)], schema.names)

    out = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    return slim.mapInArrow(run, schema).select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
