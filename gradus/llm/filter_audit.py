"""Filter interaction audit from a sparse document-term matrix.

How many documents five filters remove, in each of the 120 orders in which they can
stand, per source. Two of the filters count words and distinct words, which are the
row sums and the nonzero counts of the document-term matrix:

1. Tasks cut their texts into shards of some ``SHARD_BYTES``. A shard is a matrix in
   CSR form over its own words: ``indptr``, ``indices`` and ``data`` (occurrences).
2. The shards' distinct words go to buckets by a hash of the word. A bucket holds all
   shards' copies of its words, one for each shard, and gives every word its code:
   its rank among the bucket's sorted words and the bucket's number. Codes follow
   from the set of words alone, so a task that runs again gives the same ones.
3. The codes return to their shards and replace the shards' own numbers, so that a
   column means the same word in every shard.
4. Row sums and nonzero counts decide A and B; shares of capitals, symbols and a
   digest of the text decide the other filters. Documents are then counted by part
   and set of failed filters: 32 sets, from which all orders follow by sums.

Filters (a null text is empty): A has fewer than 50 words; B has fewer than 65
distinct words for each 100 words; C has more than 5 capitals ``A-Z`` for each 100
code points; D holds one of ``#$%&*|``; E has the text of a document with a smaller
id. Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive.

Defined results: a null or empty text fails A, and E if another empty text has a
smaller id; a null id is larger than any other; rows that share an id are compared
with other ids only, so they don't remove each other; repeated rows are counted each
time; a null source is the part ``''``; a document counts as good or toxic if any of
its label rows says so, and null labels say nothing; an empty table has no part and
gives no row. Extra columns are never read. A text longer than a shard is a shard of
its own, in the task's memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.blocks import SPACE, Block, blocks, range_names, squeezed, unsqueezed
from gradus.llm.common import buckets_for, stored, text_bytes

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = b"#$%&*|"
#: Bytes of text of one shard.
SHARD_BYTES = 16 << 20
#: Bytes of text whose distinct words one bucket holds.
BUCKET_BYTES = 32 << 20

NULL_ID = np.iinfo(np.int64).max

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

# A row is either a shard's matrix or, with a bucket, some of its words.
SHARD = (
    "shard bigint, bucket int, words binary, ids array<bigint>, parts array<string>, "
    "flags binary, digests binary, indptr binary, indices binary, data binary"
)
_KINDS = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}
_SHARD = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in SHARD.split(", "))])
CODES = "shard bigint, bucket int, ranks binary"
ROWS = "id bigint, part string, n_words bigint, n_distinct bigint, flags int, digest binary"


def _joined(words: pa.Array) -> bytes:
    """Words, none of which holds a line end, as lines."""
    _, at, held = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(held, np.uint8)[at[0] : at[-1]]
    lines = np.full(len(text) + len(words), 10, np.uint8)
    lines[np.arange(len(text)) + np.repeat(np.arange(len(words)), np.diff(at))] = text
    packed = pa.compress(lines.tobytes(), codec="zstd", asbytes=True)
    return len(lines).to_bytes(8, "little") + packed


def _lines(held: bytes) -> pa.Array:
    n = int.from_bytes(held[:8], "little")
    text = np.frombuffer(pa.decompress(held[8:], n, codec="zstd", asbytes=True), np.uint8)
    ends = np.flatnonzero(text == 10)
    offsets = np.append(0, ends + 1 - np.arange(1, len(ends) + 1)).astype(np.int64)
    data = pa.py_buffer(text[text != 10])
    kind = pa.large_binary()
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), data])


def _digests(block: Block) -> bytes:
    held = memoryview(np.ascontiguousarray(block.data))
    ends = block.offsets.tolist()
    return b"".join(
        hashlib.sha256(held[a:b]).digest() for a, b in zip(ends, ends[1:], strict=False)
    )


def _surface(block: Block) -> np.ndarray:
    """Bits 2 and 3 of each text: filters C and D."""
    data = block.data
    capitals = block.per_text((data >= 65) & (data <= 90))
    points = block.per_text((data & 0xC0) != 0x80)
    symbols = block.per_text(_SYMBOL[data])
    many = 100 * capitals > MAX_CAPITALS * points
    return (4 * many + 8 * (symbols > 0)).astype(np.uint8)


class _Shard:
    """Texts of one shard, as far as they were added."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.flags: list[np.ndarray] = []
        self.digests: list[bytes] = []

    def add(self, block: Block) -> None:
        starts, ends, first = block.words()
        self.held.append(block.data[~SPACE[block.data]])
        self.lengths.append((ends - starts).astype(np.int32))
        self.counts.append(np.diff(first))
        self.flags.append(_surface(block))
        self.digests.append(_digests(block))

    def words(self) -> pa.Array:
        lengths = np.concatenate(self.lengths)
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        data = pa.py_buffer(np.concatenate(self.held))
        n, kind = len(lengths), pa.large_binary()
        return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offsets), data])

    def rows(
        self, number: int, ids: pa.Array, parts: pa.Array, n_buckets: int
    ) -> Iterator[dict]:
        """The matrix over the shard's own words, and its words by bucket."""
        coded = self.words().dictionary_encode()
        self.held, self.lengths = [], []
        words = coded.dictionary
        # The shard's own numbers follow the buckets, so a bucket's words are a range.
        bucket = np.zeros(0, np.int32)
        if len(words):
            _, at, held = words.buffers()
            at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
            names = range_names(np.frombuffer(held, np.uint8), at[:-1], at[1:], 5)
            bucket = (names % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts = np.concatenate(self.counts)
        wide = max(1, len(words))
        cells = np.repeat(np.arange(len(counts)) * wide, counts)
        cells += place[coded.indices.to_numpy()]
        del coded
        cells, data = np.unique(cells, return_counts=True)
        row, column = cells // wide, cells % wide
        indptr = np.searchsorted(row, np.arange(len(counts) + 1))
        # Columns ascend in a row, so steps are small.
        steps = np.diff(column, prepend=0)
        begins = indptr[:-1][np.diff(indptr) > 0]
        steps[begins] = column[begins]
        yield {
            "shard": number,
            "ids": ids,
            "parts": parts,
            "flags": np.concatenate(self.flags).tobytes(),
            "digests": b"".join(self.digests),
            "indptr": squeezed(np.diff(indptr)),
            "indices": squeezed(steps),
            "data": squeezed(data),
        }
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            mine = words.take(pa.array(order[cuts[b] : cuts[b + 1]]))
            yield {"shard": number, "bucket": int(b), "words": _joined(mine)}


def _as_batch(row: dict) -> pa.RecordBatch:
    def column(field: pa.Field) -> pa.Array:
        value = row.get(field.name)
        if isinstance(value, pa.Array):
            offsets = pa.array([0, len(value)], pa.int32())
            return pa.ListArray.from_arrays(offsets, value).cast(field.type)
        return pa.array([value], field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in _SHARD], schema=_SHARD)


def _shard_rows(
    batches: Iterator[pa.RecordBatch], n_buckets: int, shard_bytes: int
) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    number = 0
    for batch in batches:
        for piece in blocks(batch.column("text"), shard_bytes):
            part = batch.slice(piece.lo, piece.hi - piece.lo)
            shard = _Shard()
            for block in blocks(part.column("text")):
                shard.add(block)
            for row in shard.rows(base + number, part.column("id"), part.column("part"), n_buckets):
                yield _as_batch(row)
            number += 1


def _coded(group: pa.Table) -> pa.Table:
    """Ranks of a bucket's words among all its distinct ones, for each shard."""
    lists = [_lines(x.as_py()) for x in group["words"]]
    ends = np.cumsum([len(x) for x in lists])
    coded = pa.concat_arrays(lists).dictionary_encode()
    del lists
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ranks = np.split(rank[coded.indices.to_numpy()], ends[:-1])
    return pa.table(
        [group["shard"], group["bucket"], pa.array([squeezed(r) for r in ranks], pa.binary())],
        ["shard", "bucket", "ranks"],
    )


def csr(row: dict, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``indptr, indices, data`` of a shard, with the codes that all shards share."""
    coded = sorted(row["coded"] or (), key=lambda c: c["bucket"])
    codes = [unsqueezed(c["ranks"]).astype(np.int64) * n_buckets + c["bucket"] for c in coded]
    sizes = unsqueezed(row["indptr"]).astype(np.int64)
    indptr = np.append(0, np.cumsum(sizes))
    # Back from steps: sums from each row's begin on.
    steps = unsqueezed(row["indices"]).astype(np.int64)
    sums = np.append(0, np.cumsum(steps))
    column = sums[1:] - np.repeat(sums[indptr[:-1]], sizes)
    indices = np.concatenate(codes)[column] if codes else column
    return indptr, indices, unsqueezed(row["data"])


def matrix(docs: DataFrame) -> tuple[DataFrame, int]:
    """CSR shards over all documents' words, and the number of buckets: rows that
    ``csr`` reads, with the documents' ``ids``, ``parts``, ``flags`` and ``digests``."""
    n_buckets, shard_bytes = buckets_for(text_bytes(docs), BUCKET_BYTES), SHARD_BYTES
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    rows = stored(
        texts.mapInArrow(lambda it: _shard_rows(it, n_buckets, shard_bytes), SHARD), "shards"
    )
    words = rows.where("bucket IS NOT NULL").select("bucket", "shard", "words")
    codes = words.groupBy("bucket").applyInArrow(_coded, CODES)
    # One row for each bucket that has words of the shard: no more than its text.
    by_shard = codes.groupBy("shard").agg(
        F.collect_list(F.struct("bucket", "ranks")).alias("coded")
    )
    shards = rows.where("bucket IS NULL").drop("bucket", "words")
    return shards.join(by_shard, "shard", "left"), n_buckets


def _document_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in ROWS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            held = {c: batch.column(c)[i].as_py() for c in ("indptr", "indices", "data", "coded")}
            indptr, _, data = csr(held, n_buckets)
            del held
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data, out=sums[1:])
            n_words = sums[indptr[1:]] - sums[indptr[:-1]]
            n_distinct = np.diff(indptr)  # a column stands for one word
            flags = np.frombuffer(batch.column("flags")[i].as_buffer(), np.uint8).astype(np.int32)
            flags += n_words < MIN_WORDS
            flags += 2 * (100 * n_distinct < MIN_DISTINCT * n_words)
            digests = batch.column("digests")[i].as_py()
            columns = [
                batch.column("ids")[i].values,
                batch.column("parts")[i].values,
                n_words,
                n_distinct,
                flags,
                [digests[k : k + 32] for k in range(0, len(digests), 32)],
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, k)
                    for c, k in zip(columns, kinds, strict=True)
                ],
                names,
            )


def document_rows(docs: DataFrame) -> DataFrame:
    """``id, part, n_words, n_distinct, flags`` of every document: ``flags`` has bit i
    for the i-th filter that it fails. A null id is the largest number."""
    shards, n_buckets = matrix(docs)
    rows = stored(shards.mapInArrow(lambda it: _document_rows(it, n_buckets), ROWS), "audited")
    first = rows.groupBy("digest").agg(F.min("id").alias("least"))
    again = F.when(F.col("id") > F.col("least"), 16).otherwise(0)
    return rows.join(first, "digest").select(
        "id", "part", "n_words", "n_distinct", (F.col("flags") + again).alias("flags")
    )


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, flags, n, good, toxic``: documents of each part by the filters that
    they fail."""
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("id")
    )
    said = named.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    rows = document_rows(docs).select("id", "part", "flags").join(said, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("part", "flags").agg(
        F.count(F.lit(1)).alias("n"), total("good"), total("toxic")
    )


def _steps() -> Column:
    """All orders and steps: ``o, s, before`` (bits of the filters applied earlier) and
    ``own`` (the step's filter)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            name = "".join(FILTERS[i] for i in order)
            rows.append({"o": name, "s": step, "before": before, "own": 1 << f})
            before |= 1 << f
    kind = "array<struct<o:string,s:int,before:int,own:int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    sets = failing_sets(docs, labels)
    counts = sets.groupBy("part").agg(
        F.collect_list(F.struct("flags", "n", "good", "toxic")).alias("sets")  # 32 at most
    )
    steps = counts.select("part", "sets", F.explode(_steps()).alias("at"))
    own, before = F.col("at.own"), F.col("at.before")

    def total(of: str, where) -> Column:
        return F.aggregate(
            F.filter("sets", where), F.lit(0).cast("bigint"), lambda n, s: n + s[of]
        )

    def first(s: Column) -> Column:
        return (s["flags"].bitwiseAND(own) != 0) & (s["flags"].bitwiseAND(before) == 0)

    def late(s: Column) -> Column:
        return (s["flags"].bitwiseAND(own) != 0) & (s["flags"].bitwiseAND(before) != 0)

    # In the share of orders in which it stands first of the filters that a document
    # fails, a filter removes that document.
    share = F.aggregate(
        F.filter("sets", lambda s: s["flags"].bitwiseAND(own) != 0),
        F.lit(0).cast("bigint"),
        lambda n, s: n + s["n"] * (F.lit(120) / F.bit_count(s["flags"])).cast("bigint"),
    )
    return steps.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        total("n", lambda s: s["flags"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", first).alias("removed"),
        total("n", late).alias("redundant"),
        total("n", lambda s: s["flags"] == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        share.alias("shapley"),
    )
