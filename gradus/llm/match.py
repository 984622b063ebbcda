"""Find equal keys in different documents without a row per key.

A task packs the keys of a block of documents by bucket of the key: one row per
block and bucket, with arrays of owners and keys. A shuffle brings a bucket
together; the keys that match are sent back to their documents. Before the shuffle
each block keeps one item per key and row of the key's least id, so a key that most
documents hold costs one item per block unless they share an id; what a block can
settle alone goes along as a bit mask, and its key without an owner.

An owner is a document row: its id (which orders owners; null is the largest) and
a hash of its text. Rows equal in both get equal results; rows equal in id alone
each get their own. A key that comes back stands for all items of its document that
have it.

Without ``checks`` only 32 bits of a key are sent, beside its bucket: a filter with
few false matches. With ``checks`` the 64 bits of the key and 32 more are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.blocks import mix

NULL_ID = np.iinfo(np.int64).max

PACKED = (
    "bucket int, ids binary, hashes binary, counts binary, keys binary, "
    "checks binary, mask binary"
)
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
FLAGS = "id bigint, hash bigint, keys binary, mask binary"
_FLAG_NAMES = [x.split()[0] for x in FLAGS.split(", ")]

#: Items are sent back where the key is held by two documents, by an earlier one, or
#: by any other item.
SHARED, LATER, TWICE = "shared", "later", "twice"


def owned(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` after ``id`` and ``hash``, by which flags are brought back."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("id"),
        F.xxhash64("text").alias("hash"),
        *columns,
    )


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in the order."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def _judge(order: np.ndarray, starts: np.ndarray, ids: np.ndarray, mode: str):
    """Of the items in order: is it settled, and its key's least id."""
    if not len(order):
        return np.zeros(0, bool), ids
    sizes = np.diff(np.append(starts, len(order)))
    ids = ids[order]
    least = np.repeat(np.minimum.reduceat(ids, starts), sizes)
    if mode == TWICE:
        return np.repeat(sizes > 1, sizes), least
    if mode == LATER:
        return ids > least, least
    return np.repeat(np.maximum.reduceat(ids, starts), sizes) > least, least


def _sorted(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal keys (and checks) stand together; where each begins."""
    order = np.argsort(keys)
    starts = _groups(order, keys)
    if checks is not None:
        both = _groups(order, keys, checks)
        if len(both) > len(starts):  # equal keys with different checks
            order = np.lexsort((checks, keys))
            starts = _groups(order, keys, checks)
        # otherwise the checks agree wherever the keys do
    return order.astype(np.int32), starts


def _twins(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each row, the first one that is equal in id and hash."""
    order = np.lexsort((hashes, ids))
    starts = _groups(order, ids, hashes)
    out = np.empty(len(ids), np.int64)
    out[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    return out


def pack(
    ids: np.ndarray,
    hashes: np.ndarray,
    first: np.ndarray,
    keys: np.ndarray,
    n_buckets: int,
    mode: str,
    checks: np.ndarray | None = None,
    items: np.ndarray | None = None,
) -> Iterator[dict]:
    """Rows of ``PACKED`` for one block.

    ``first``: each document's first entry in ``keys``. ``items``: number of each
    key's item in its document, for the mask (default: in order).
    """
    n = len(keys)
    if not n:
        return
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    if items is None:
        items = np.arange(n) - first[:-1][owner]
    order = np.argsort(keys, kind="stable")
    starts = _groups(order, keys)
    done, least = _judge(order, starts, ids[owner], mode)
    settled = np.zeros(n, bool)
    settled[order[done]] = True
    # Of each row with a key's least id the first item is sent. Where these are settled
    # the key needs one item for the other blocks, and none comes back.
    lead = np.flatnonzero(ids[owner][order] == least)
    group = np.searchsorted(starts, lead, "right") - 1
    row = np.where(done[lead], 0, _twins(ids, hashes)[owner[order[lead]]])
    sent = np.sort(order[lead[np.unique(group * len(ids) + row, return_index=True)[1]]])
    bucket = bucket_of(keys[sent], n_buckets)
    by = np.lexsort((settled[sent], bucket))
    sent, bucket = sent[by], bucket[by]
    free = settled[sent]
    cuts = _groups(np.arange(len(bucket)), bucket, free)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(sent)), strict=True):
        part = sent[lo:hi]
        who, counts = np.unique(owner[part], return_counts=True)
        yield {
            "bucket": int(bucket[lo]),
            "ids": None if free[lo] else ids[who].tobytes(),
            "hashes": None if free[lo] else hashes[who].tobytes(),
            "counts": None if free[lo] else counts.astype(np.int32).tobytes(),
            # The bucket and these bits are what is compared.
            "keys": keys[part].tobytes()
            if checks is not None
            else keys[part].astype(np.uint32).tobytes(),
            "checks": checks[part].astype(np.uint32).tobytes()
            if checks is not None
            else None,
            "mask": None,
        }
    for d in np.unique(owner[settled]):
        mine = slice(first[d], first[d + 1])
        bits = np.zeros(int(items[mine].max()) + 1, bool)
        bits[items[mine][settled[mine]]] = True
        yield {
            "bucket": int(hashes[d] % n_buckets),
            "ids": ids[d : d + 1].tobytes(),
            "hashes": hashes[d : d + 1].tobytes(),
            "counts": None,
            "keys": None,
            "checks": None,
            "mask": np.packbits(bits).tobytes(),
        }


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(
        np.int32
    )


def packed_batches(rows: Iterator[dict], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    kinds = [pa.int32()] + [pa.binary()] * 6
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield _batch(held, _NAMES, kinds)
            held = []
    if held:
        yield _batch(held, _NAMES, kinds)


def _batch(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)],
        names,
    )


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def joined(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all values of a binary column, one after another; null is none."""
    if isinstance(column, pa.ChunkedArray):
        parts = [joined(x, kind) for x in column.chunks]
        return np.concatenate(parts) if parts else np.zeros(0, kind)
    column = pc.drop_null(column)
    _, at, held = column.buffers()
    if not len(column) or held is None:
        return np.zeros(0, kind)
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(at, np.int64 if wide else np.int32)
    lo, hi = at[column.offset], at[column.offset + len(column)]
    return np.frombuffer(held, np.uint8)[lo:hi].copy().view(kind)


def _matcher(mode: str):
    def match(group: pa.Table) -> pa.Table:
        is_mask = pc.is_valid(group["mask"])
        masks = group.select(["ids", "hashes", "mask"]).filter(is_mask)
        # Of the large columns no second copy is made: they are null where a mask is.
        # Keys without an owner come in any place.
        is_owned = pc.is_valid(group["counts"])
        rows = group.select(["ids", "hashes", "counts"]).filter(is_owned)
        ids = _flat(rows["ids"], np.int64)
        hashes = _flat(rows["hashes"], np.int64)
        counts = _flat(rows["counts"], np.int32)
        del rows
        exact = group["checks"].null_count < len(group)
        kind = np.uint64 if exact else np.uint32
        sizes = pc.fill_null(pc.binary_length(group["keys"]), 0).to_numpy() // kind().itemsize
        keys = joined(group["keys"], kind)
        checks = joined(group["checks"], np.uint32) if exact else None
        owner = np.full(len(keys), len(ids), np.int32)
        owner[np.repeat(is_owned.to_numpy(), sizes)] = np.repeat(
            np.arange(len(ids), dtype=np.int32), counts
        )
        del group, sizes
        out = {
            "id": _flat(masks["ids"], np.int64),
            "hash": _flat(masks["hashes"], np.int64),
            "keys": [None] * len(masks),
            "mask": masks["mask"].to_pylist(),
        }
        if len(keys):
            order, starts = _sorted(keys, checks)
            del checks
            # Ranks compare like ids and take less room. What has no owner is held
            # by more than one: it is like no other id.
            rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
            rank = np.append(rank, np.int32(len(ids)))
            done, _ = _judge(order, starts, rank[owner], mode)
            hit = np.sort(order[done])
            hit = hit[owner[hit] < len(ids)]
            who = owner[hit]
            cuts = _groups(np.arange(len(who)), who)
            ends = np.append(cuts, len(hit))[1:]
            back = [keys[hit[a:b]].tobytes() for a, b in zip(cuts, ends, strict=True)]
            out["id"] = np.concatenate([out["id"], ids[who[cuts]]])
            out["hash"] = np.concatenate([out["hash"], hashes[who[cuts]]])
            out["keys"] = out["keys"] + back
            out["mask"] = out["mask"] + [None] * len(back)
        return pa.table(
            [
                pa.array(out["id"], pa.int64()),
                pa.array(out["hash"], pa.int64()),
                pa.array(out["keys"], pa.binary()),
                pa.array(out["mask"], pa.binary()),
            ],
            _FLAG_NAMES,
        )

    return match


def flags(packed: DataFrame, mode: str) -> DataFrame:
    """``id, hash, flags``: per document the parts that ``read_flags`` puts together."""
    found = packed.groupBy("bucket").applyInArrow(_matcher(mode), FLAGS)
    return found.groupBy("id", "hash").agg(
        F.collect_list(F.struct("keys", "mask")).alias("flags")
    )


def with_flags(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """``docs`` with column ``flags`` (null: none). The smaller side is hashed, so
    texts are shuffled but never sorted."""
    return docs.join(flagged.hint("shuffle_hash"), ["id", "hash"], "left")


def read_flags(
    flags: pa.Array, keys: np.ndarray, first: np.ndarray, short: bool
) -> np.ndarray:
    """Which of a block's items are flagged. ``first``: each document's first entry
    in ``keys``; ``short``: the keys were sent without checks."""
    out = np.zeros(len(keys), bool)
    kind = np.uint32 if short else np.uint64
    back, whose = [], []
    for d, parts in enumerate(flags.to_pylist()):
        for part in parts or ():
            if part["keys"] is not None:
                back.append(np.frombuffer(part["keys"], kind))
                whose.append(np.full(len(back[-1]), d))
            if part["mask"] is not None:
                bits = np.unpackbits(np.frombuffer(part["mask"], np.uint8))
                bits = bits[: first[d + 1] - first[d]]
                out[first[d] : first[d] + len(bits)] |= bits.astype(bool)
    if back:
        # Only the texts that got keys back.
        whose = np.concatenate(whose)
        got = np.zeros(len(first) - 1, bool)
        got[whose] = True
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(got[owner])
        mine = keys[at].astype(kind).astype(np.uint64)
        sent = np.concatenate(back).astype(np.uint64)
        out[at] |= np.isin(_own(mine, owner[at]), _own(sent, whose))
    return out


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys told apart by document."""
    return mix(keys ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
