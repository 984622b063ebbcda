"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token's tokens are the pieces of its best split under a unigram model. The
distinct pre-tokens of a block are put into a trie; a node's forward score is the
best score of any split of its prefix, and is computed once for all pre-tokens that
begin with it. Pre-tokens store the number of pieces at their terminal node, and a
document's count is the sum over its pre-tokens.

The pieces come from a public vocabulary file of ranks, given by its path. It has no
probabilities; a piece of rank r gets log(1 / (r + 1)), as frequencies fall with the
rank. Every single byte is a piece, so every text has a count. Equal scores go to
the split of fewer pieces.

The vocabulary is read by the driver and sent to the executors: its size is fixed by
the file (about 1 MB), not by the documents. No shuffle.

Defined results: a null or empty text has 0 of both; null ids and repeated rows are
kept as they are; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.blocks import blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, digits, other signs (each with one space before), spaces.
PRE_TOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
BLOCK_BYTES = 4 << 20
#: Pre-tokens that a task remembers from block to block; then it starts anew.
REMEMBERED = 500_000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(piece): int(rank) for piece, rank in pairs}


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    from math import log

    scores = {piece: -log(rank + 1) for piece, rank in ranks.items()}
    missing = [b for b in range(256) if bytes([b]) not in scores]
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    return scores


def backward_trie(scores: dict[bytes, float]) -> dict:
    """Pieces by their bytes from the end; a piece's score is at key -1."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for byte in reversed(piece):
            node = node.setdefault(byte, {})
        node[-1] = score
    return root


def terminal_counts(pretokens: list[bytes], pieces: dict) -> list[int]:
    """Number of pieces of each pre-token. ``pretokens`` are sorted, which is the
    order of their trie in depth; the lists hold the scores on the path to the
    present node."""
    score, count, out, path = [0.0], [0], [], b""
    for token in pretokens:
        shared, limit = 0, min(len(path), len(token))
        while shared < limit and path[shared] == token[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            best, least, node, at = float("-inf"), 0, pieces, end - 1
            while at >= 0:
                node = node.get(token[at])
                if node is None:
                    break
                if -1 in node:
                    total, number = score[at] + node[-1], count[at] + 1
                    if total > best or (total == best and number < least):
                        best, least = total, number
                at -= 1
            score.append(best)
            count.append(least)
        out.append(count[len(token)])
        path = token
    return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row."""
    spark = docs.sparkSession
    scores = spark.sparkContext.broadcast(piece_scores(read_vocabulary(vocabulary)))
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [
            slim.schema["doc_id"],
            T.StructField("n_pretokens", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, pieces = regex.compile(PRE_TOKEN), backward_trie(scores.value)
        known: dict[str, int] = {}
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                cuts = zip(block.offsets[:-1], block.offsets[1:], strict=True)
                found = [
                    pattern.findall(block.data[a:b].tobytes().decode()) for a, b in cuts
                ]
                if len(known) > REMEMBERED:
                    known.clear()
                new = set().union(*found).difference(known)
                order = sorted((t.encode(), t) for t in new)
                counts = terminal_counts([t for t, _ in order], pieces)
                known.update(zip((t for _, t in order), counts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.lo, block.hi - block.lo),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([sum(map(known.__getitem__, f)) for f in found], pa.int64()),
                    ],
                    schema.names,
                )

    return slim.mapInArrow(count, schema)
