"""Substring dedup by recompression: remove long word sequences seen earlier.

Words get names (fingerprints of their bytes). Rounds then shorten every text: a
round on runs names each maximal run of one symbol, a round on pairs splits the
symbols into left and right by a bit of their name and names each left-right pair.
A new symbol's name follows from what it stands for, so equal sequences get equal
names in all tasks and no dictionary is shuffled. Beside its name each symbol
carries the stretch of words that its making depends on: symbols whose stretch lies
inside a window are the same wherever the window occurs.

1. Symbols that one window can hold are matched over all documents. A window can
   only repeat in another document if all symbols inside it are shared.
2. The windows left are verified: their whole content is compared by 96-bit
   fingerprints of independent word names.
3. Windows that also start in a document with a smaller id are removed.

Defined results: a null text has no words; a null id is larger than any other;
rows with one id count as one document, so they don't remove each other's words;
ties have no effect beyond that; an empty table gives an empty result. A text of
any length is worked on whole, in the task's memory. Extra columns are ignored by
``removed_words`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm import match as M
from gradus.llm.blocks import blocks, mix, owners, range_names, seeded, windows
from gradus.llm.common import buckets_for, text_bytes

WINDOW = 13
ROUNDS = ("runs", "pairs", "pairs", "pairs")
#: Bytes of text whose keys one bucket holds.
BUCKET_BYTES = 48 << 20

_FAR = 1 << 40


class Symbols:
    """Symbols of a block's texts. ``low``/``high``: first word and word after the
    last that a symbol's making depends on."""

    def __init__(self, names: np.ndarray, text: np.ndarray) -> None:
        self.names, self.text = names, text
        self.low = np.arange(len(names))
        self.high = self.low + 1

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """``low`` of the symbol before, ``high`` of the one after. At a text's end
        the making depends on the end, which no window shows."""
        n = len(self.names)
        same = self.text[1:] == self.text[:-1]
        before, after = np.full(n, -_FAR), np.full(n, _FAR)
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after

    def runs(self, seed: int) -> None:
        n = len(self.names)
        new = np.ones(n, bool)
        new[1:] = (self.names[1:] != self.names[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        before, after = self._neighbours()
        length = last - first + 1
        named = mix(self.names[first] + length.astype(np.uint64) * seeded(seed, 1)[0])
        self.low = np.minimum(self.low[first], before[first])
        self.high = np.maximum(self.high[last], after[last])
        self.names = np.where(length > 1, named, self.names[first])
        self.text = self.text[first]

    def pairs(self, seed: int) -> None:
        turn, factor = seeded(seed, 2)
        right = (mix(self.names + turn) >> np.uint64(7)) & np.uint64(1) == 1
        n = len(self.names)
        opens, closes = np.zeros(n, bool), np.zeros(n, bool)
        opens[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        closes[1:] = opens[:-1]
        before, after = self._neighbours()
        # That a left symbol stays alone is known from the next one, and so on.
        low = np.where(right & ~closes, np.minimum(self.low, before), self.low)
        high = np.where(right, self.high, np.maximum(self.high, after))
        at = np.flatnonzero(opens)
        names = self.names.copy()
        names[at] = mix(self.names[at] * factor + self.names[at + 1])
        keep = ~closes
        self.names, self.text = names[keep], self.text[keep]
        self.low, self.high = low[keep], high[keep]


def symbols(names: np.ndarray, first: np.ndarray, window: int) -> Symbols:
    """The symbols that a window can hold, after all rounds."""
    out = Symbols(names, owners(first))
    if len(names):
        for seed, kind in enumerate(ROUNDS, 101):
            getattr(out, kind)(seed)
    keep = out.high - out.low <= window
    for name in ("names", "text", "low", "high"):
        setattr(out, name, getattr(out, name)[keep])
    return out


def _first_of(text: np.ndarray, n_texts: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n_texts + 1))


def _ids(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(lo, hi - lo)
    return (
        part.column("id").to_numpy(zero_copy_only=False),
        part.column("hash").to_numpy(zero_copy_only=False),
    )


def _symbol_rows(batches: Iterator[pa.RecordBatch], window: int, n_buckets: int):
    for batch in batches:
        for block in blocks(batch.column("text")):
            starts, ends, first = block.words()
            found = symbols(range_names(block.data, starts, ends), first, window)
            at = _first_of(found.text, block.hi - block.lo)
            ids, hashes = _ids(batch, block.lo, block.hi)
            yield from M.pack(ids, hashes, at, found.names, n_buckets, M.SHARED)


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, n_buckets: int):
    for batch in batches:
        for block in blocks(batch.column("text")):
            n = block.hi - block.lo
            starts, ends, first = block.words()
            names = range_names(block.data, starts, ends)
            found = symbols(names, first, window)
            place = _first_of(found.text, n)
            part = batch.column("flags").slice(block.lo, n)
            shared = M.read_flags(part, found.names, place, True)
            # A window at i holds symbols with low >= i and high <= i + window.
            single = ~shared
            barred = np.zeros(len(names) + 1, np.int64)
            np.add.at(barred, np.maximum(found.high[single] - window, 0), 1)
            np.add.at(barred, found.low[single] + 1, -1)
            barred = np.cumsum(barred)[:-1] > 0
            keys, at = windows(names, first, window)
            open_ = ~barred[at]
            keys, at = keys[open_], at[open_]
            other = range_names(block.data, starts, ends, 1)
            checks, every = windows(other, first, window, 1)
            checks = checks[np.searchsorted(every, at)]
            ids, hashes = _ids(batch, block.lo, block.hi)
            text = owners(first)[at]
            yield from M.pack(
                ids,
                hashes,
                _first_of(text, n),
                keys,
                n_buckets,
                M.LATER,
                checks,
                at - first[:-1][text],
            )


def _covered(block, flags: pa.Array, window: int):
    """Words of a block, and which of them are removed."""
    starts, ends, first = block.words()
    keys, at = windows(range_names(block.data, starts, ends), first, window)
    place = _first_of(owners(first)[at], len(first) - 1)
    hit = M.read_flags(flags, keys, place, False)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[hit], 1)
    np.add.at(cover, at[hit] + window, -1)
    return first, np.cumsum(cover)[:-1] > 0


def _results(batches: Iterator[pa.RecordBatch], names: list[str], text_at: int | None, window: int):
    """``names`` of the input, then the result columns. ``text_at``: place of the
    text among them, which is then rewritten."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            n = block.hi - block.lo
            part = batch.slice(block.lo, n)
            first, gone = _covered(block, part.column("flags"), window)
            removed, digests, texts = [], [], []
            for d in range(n):
                raw = block.data[block.offsets[d] : block.offsets[d + 1]].tobytes()
                cut = gone[first[d] : first[d + 1]]
                count = int(cut.sum())
                left = raw.split()
                if count:
                    left = compress(left, ~cut)
                kept = b" ".join(left)
                removed.append(count)
                digests.append(hashlib.sha256(kept).hexdigest())
                if text_at is not None:
                    texts.append((kept if count else raw).decode())
            # A null text stays null.
            null = np.asarray(part.column("text").is_null())
            columns = [
                pa.array(texts, pa.string(), mask=null) if i == text_at else part.column(n)
                for i, n in enumerate(names)
            ]
            columns += [
                pa.array(np.diff(first), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, [*names, "n_words", "n_removed", "kept_sha256"]
            )


def _repeated(texts: DataFrame, n_buckets: int, window: int) -> DataFrame:
    """The windows of each text to remove."""
    found = texts.select("id", "hash", "text").mapInArrow(
        lambda it: M.packed_batches(_symbol_rows(it, window, n_buckets)), M.PACKED
    )
    shared = M.with_flags(texts, M.flags(found, M.SHARED))
    found = shared.mapInArrow(
        lambda it: M.packed_batches(_window_rows(it, window, n_buckets)), M.PACKED
    )
    return M.flags(found, M.LATER)


def _cut(docs: DataFrame, columns: list[str], rewrite: bool, window: int) -> DataFrame:
    """``columns`` as ``c0``, ``c1``, ... and the result columns. Both joins take the
    same columns, so that Spark shuffles the texts once."""
    names = [f"c{i}" for i in range(len(columns))]
    extra = [F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    if rewrite:  # the text is there already
        extra.pop(columns.index("text"))
    texts = M.owned(docs, F.col("text").cast("string").alias("text"), *extra)
    joined = M.with_flags(texts, _repeated(texts, n_buckets, window))
    at = columns.index("text") if rewrite else None
    fields = [
        T.StructField(n, docs.schema[c].dataType) for c, n in zip(columns, names, strict=True)
    ]
    schema = T.StructType(
        fields
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return joined.mapInArrow(lambda it: _results(it, names, at, window), schema)


def removed_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    slim = docs.select("doc_id", "text")
    out = _cut(slim, ["doc_id"], False, window)
    return out.withColumnRenamed("c0", "doc_id")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the words that an earlier one has; texts without
    such words stay as they are, and rows left without words go. ``n_chars``
    follows the text."""
    columns = docs.columns
    out = _cut(docs, columns, True, window)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    out = out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
