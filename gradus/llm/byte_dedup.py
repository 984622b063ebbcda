"""Repeated byte strings: remove what any 200 bytes share with another place.

A suffix array of all bytes has at least eight bytes for each byte of text, so here
suffixes are sorted only where repeats begin and end. Three steps:

1. Sample. Cuts are set where an 8-byte hash is the least of some ``SPAN``
   consecutive ones: every ``SPAN`` bytes hold a cut, and cuts inside a repeated
   string are the same wherever it stands, which positions counted from the start
   of a text are not. The string between two cuts is a piece.
2. Sort the sampled places by their piece and the stretch around it that holds all
   windows for which this piece is the first inside. A window in a stretch that
   occurs twice is repeated. A piece that occurs once rules its windows out.
3. Only where a piece stands in different stretches can windows be repeated whose
   stretch is not. One place of each stretch of such a piece takes part in a sort
   of the windows themselves, all others are settled.

Strings are compared by 96 bits of independent fingerprints, and pieces, which only
choose what is compared, by 32 bits and their bucket.

Defined results: a null text is empty; texts shorter than the window lose nothing to
themselves or others; strings never cross texts; repeated rows remove each other, as
all places do; null ids are kept; an empty table gives an empty result. A text of any
length is worked on whole, in the task's memory. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm import match as M
from gradus.llm.blocks import CACHED_BYTES, Block, blocks, byte_sums, names_of, range_names
from gradus.llm.common import buckets_for, text_bytes

WINDOW = 200
SPAN = 48
GRAM = 8
#: Cuts at least so far inside a window don't depend on what is around it.
MARGIN = SPAN + GRAM
BUCKET_BYTES = 80 << 20
BLOCK_BYTES = 1 << 20

_SETTLED, _SORTED = 1, 2
#: ``np.add.at`` is many times slower with a plain number.
_ONE = np.int32(1)

PLACES = "bucket int, ids binary, hashes binary, counts binary, pieces binary, keys binary, checks binary, several binary, mask binary"
_NAMES = [x.split()[0] for x in PLACES.split(", ")]
VERDICTS = "id bigint, hash bigint, keys binary, codes binary, mask binary"
_VERDICT_NAMES = [x.split()[0] for x in VERDICTS.split(", ")]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        more = min(have, width - have)
        out = pick(out[: len(out) - more], out[more:])
        have += more
    return out


def cuts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts of a block's texts, as offsets. A text's cuts don't depend on the texts
    around it, and a cut on no more than ``SPAN`` hashes to each side: a stretch at a
    time is searched with what it needs around it."""
    n = len(data) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, np.int64)
    found = []
    for lo in range(0, n, CACHED_BYTES):
        hi = min(lo + CACHED_BYTES, n)
        start, stop = max(lo - SPAN + 1, 0), min(hi + MARGIN, len(data))
        edges = offsets[np.searchsorted(offsets, start, "right") : np.searchsorted(offsets, stop)]
        at = _cuts_within(data[start:stop], edges - start) + start
        found.append(at[(at >= lo) & (at < hi)])
    return np.concatenate(found) + GRAM


def _cuts_within(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the 8 bytes before a cut start; ``edges``: where texts begin."""
    n = len(data) - GRAM + 1
    wide = data.astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    for j in range(GRAM):
        gram *= np.uint32(0x01000193)
        gram ^= wide[j : j + n]
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    gram ^= gram >> np.uint32(12)
    pad = np.zeros(n + SPAN - 1, np.uint32)
    least = pad[SPAN - 1 : n]
    least[:] = _sliding(gram, SPAN, np.minimum)
    # Stretches that reach over a text's end choose nothing.
    if len(edges):
        over = np.zeros(len(data) + 1, np.int32)
        np.add.at(over, np.maximum(edges - MARGIN + 2, 0), _ONE)
        np.add.at(over, edges, -_ONE)
        least[np.cumsum(over, dtype=np.int32)[: len(least)] > 0] = 0
    # A place is a cut if it is the least of any stretch that holds it.
    best = _sliding(pad, SPAN, np.maximum)
    return np.flatnonzero((best == gram) & (gram > 0))


class Places:
    """Pieces of a block: the first and last start of the windows that have it as
    their first piece, and the stretch that holds them. ``sent``: with the names that
    only the sorting of places needs."""

    def __init__(self, block: Block, sent: bool = False) -> None:
        data, offsets = block.data, block.offsets
        cuts = cuts_of(data, offsets)
        cuts = cuts[~np.isin(cuts, offsets)]  # not at a text's end
        text = np.searchsorted(offsets, cuts, "right") - 1
        same = text[1:] == text[:-1]
        before = np.full(len(cuts), -(1 << 40))
        before[1:][same] = cuts[:-1][same]
        start, end = offsets[text], offsets[text + 1]
        at = np.flatnonzero(np.append(same, False)[: len(cuts)] & (end - start >= WINDOW))
        self.text = text[at]
        self.begin, self.stop = cuts[at], cuts[at + 1] if len(at) else cuts[at]
        self.low = np.maximum(before[at] - MARGIN + 1, start[at])
        self.high = np.minimum(self.begin - MARGIN, end[at] - WINDOW)
        # Pieces that no window has first count all the same, with no windows.
        none = self.high < self.low
        self.low = np.where(none, self.begin, self.low)
        reach = np.where(none, self.stop, self.high + WINDOW)
        self.high = np.where(none, self.low - 1, self.high)
        sums = byte_sums(data, 2)
        self.keys = names_of(sums, self.low, reach)
        if sent:
            self.pieces = names_of(sums, self.begin, self.stop)
            self.checks = range_names(data, self.low, reach, 3).astype(np.uint32)
        self.first = np.searchsorted(self.text, np.arange(block.hi - block.lo + 1))


def _place_rows(ids, hashes, places: Places, n_buckets: int) -> Iterator[dict]:
    """Rows of ``PLACES``: a stretch that a block holds more than once is sent once;
    its other places are settled by a mask."""
    keys, first = places.keys, places.first
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    starts = M._groups(order, keys)
    sizes = np.diff(np.append(starts, len(order)))
    lead = order[starts]
    several = np.zeros(len(keys), np.uint8)
    several[lead] = sizes > 1
    settled = np.ones(len(keys), bool)
    settled[lead] = False
    bucket = M.bucket_of(places.pieces[lead], n_buckets)
    by = np.lexsort((lead, bucket))
    sent, bucket = lead[by], bucket[by]
    cuts = M._groups(np.arange(len(bucket)), bucket)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(sent)), strict=True):
        part = sent[lo:hi]
        who, counts = np.unique(places.text[part], return_counts=True)
        yield {
            "bucket": int(bucket[lo]),
            "ids": ids[who].tobytes(),
            "hashes": hashes[who].tobytes(),
            "counts": counts.astype(np.int32).tobytes(),
            "pieces": places.pieces[part].astype(np.uint32).tobytes(),
            "keys": keys[part].tobytes(),
            "checks": places.checks[part].tobytes(),
            "several": several[part].tobytes(),
            "mask": None,
        }
    empty = dict.fromkeys(_NAMES)
    for d in np.unique(places.text[settled]):
        yield empty | {
            "bucket": int(hashes[d] % n_buckets),
            "ids": ids[d : d + 1].tobytes(),
            "hashes": hashes[d : d + 1].tobytes(),
            "mask": np.packbits(settled[first[d] : first[d + 1]]).tobytes(),
        }


def _sort_places(group: pa.Table) -> pa.Table:
    """Sort the places of a bucket by piece and stretch, and compare neighbours."""
    is_mask = pc.is_valid(group["mask"])
    masks = group.select(["ids", "hashes", "mask"]).filter(is_mask)
    rows = group.select(["ids", "hashes", "counts"]).filter(pc.invert(is_mask))
    ids, hashes = M._flat(rows["ids"], np.int64), M._flat(rows["hashes"], np.int64)
    counts = M._flat(rows["counts"], np.int32)
    del rows
    # Of the large columns no second copy is made: they are null where a mask is.
    pieces = M.joined(group["pieces"], np.uint32)
    keys = M.joined(group["keys"], np.uint64)
    checks = M.joined(group["checks"], np.uint32)
    several = M.joined(group["several"], np.uint8)
    del group
    out = {
        "id": M._flat(masks["ids"], np.int64),
        "hash": M._flat(masks["hashes"], np.int64),
        "keys": [None] * len(masks),
        "codes": [None] * len(masks),
        "mask": masks["mask"].to_pylist(),
    }
    if len(keys):
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        order = np.lexsort((checks, keys, pieces))
        by_piece = M._groups(order, pieces)
        by_stretch = M._groups(order, pieces, keys, checks)
        size = np.diff(np.append(by_stretch, len(order)))
        more = np.maximum.reduceat(several[order], by_stretch) > 0
        del pieces, checks, several
        twice = np.repeat((size > 1) | more, size)
        first = np.zeros(len(order), bool)
        first[by_stretch] = True
        # Pieces in more than one stretch have windows to be sorted.
        n_stretches = np.add.reduceat(first.astype(np.int64), by_piece)
        span = np.diff(np.append(by_piece, len(order)))
        mixed = np.repeat(n_stretches > 1, span)
        code = twice * np.uint8(_SETTLED) + (mixed & first) * np.uint8(_SORTED)
        codes = np.zeros(len(order), np.uint8)
        codes[order] = code
        hit = np.flatnonzero(codes)
        who = owner[hit]
        cuts = M._groups(np.arange(len(who)), who)
        ends = np.append(cuts, len(hit))[1:]
        parts = [hit[a:b] for a, b in zip(cuts, ends, strict=True)]
        out["id"] = np.concatenate([out["id"], ids[who[cuts]]])
        out["hash"] = np.concatenate([out["hash"], hashes[who[cuts]]])
        out["keys"] = out["keys"] + [keys[x].tobytes() for x in parts]
        out["codes"] = out["codes"] + [codes[x].tobytes() for x in parts]
        out["mask"] = out["mask"] + [None] * len(parts)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table(
        [pa.array(out[n], k) for n, k in zip(_VERDICT_NAMES, kinds, strict=True)],
        _VERDICT_NAMES,
    )


def _read_places(column: pa.Array, places: Places) -> np.ndarray:
    """Codes of a block's places. 0: the piece occurs nowhere else."""
    codes = np.zeros(len(places.keys), np.uint8)
    if not len(codes):
        return codes
    parts, whose = column.flatten(), pc.list_parent_indices(column).to_numpy()
    masks, keys, got = (pc.struct_field(parts, c) for c in ("mask", "keys", "codes"))
    is_mask = pc.is_valid(masks).to_numpy(zero_copy_only=False)
    for d, mask in zip(whose[is_mask], masks.filter(pc.is_valid(masks)), strict=True):
        lo, hi = places.first[d], places.first[d + 1]
        bits = np.unpackbits(np.frombuffer(mask.as_buffer(), np.uint8))[: hi - lo]
        codes[lo:hi] |= bits * np.uint8(_SETTLED)
    if not is_mask.all():
        whose = np.repeat(whose, pc.fill_null(pc.binary_length(got), 0).to_numpy())
        keys, got = M.joined(keys, np.uint64), M.joined(got, np.uint8)
        keys = M._own(keys, whose)
        # Rows equal in id and text get back what each of them has found.
        order = np.argsort(keys)
        starts = M._groups(order, keys)
        keys, got = keys[order][starts], np.bitwise_or.reduceat(got[order], starts)
        mine = M._own(places.keys, places.text)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        codes |= np.where(keys[at] == mine, got[at], np.uint8(0))
    return codes


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers from each low to its high."""
    n = high - low + 1
    return np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _ids(batch: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(block.lo, block.hi - block.lo)
    return tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))


def _first_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[dict]:
    for batch in batches:
        for block in blocks(batch.column("text"), BLOCK_BYTES):
            yield from _place_rows(*_ids(batch, block), Places(block, sent=True), n_buckets)


def _second_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[dict]:
    """Windows to be sorted: those of the places chosen, unless they hold a piece
    that occurs once."""
    for batch in batches:
        for block in blocks(batch.column("text"), BLOCK_BYTES):
            n = block.hi - block.lo
            places = Places(block)
            codes = _read_places(batch.column("places").slice(block.lo, n), places)
            chosen = (codes & _SORTED) > 0
            at = _ranges(places.low[chosen], places.high[chosen])
            barred = np.zeros(len(block.data) + 2, np.int32)
            single = codes == 0
            lo = np.maximum(places.stop[single] - WINDOW + SPAN, 0)
            hi = places.begin[single] - MARGIN
            ok = hi >= lo
            np.add.at(barred, lo[ok], _ONE)
            np.add.at(barred, hi[ok] + 1, -_ONE)
            at = at[np.cumsum(barred, dtype=np.int32)[at] == 0]
            text = np.searchsorted(block.offsets, at, "right") - 1
            yield from M.pack(
                *_ids(batch, block),
                np.searchsorted(text, np.arange(n + 1)),
                range_names(block.data, at, at + WINDOW, 4),
                n_buckets,
                M.TWICE,
                range_names(block.data, at, at + WINDOW, 5),
                at - block.offsets[text],
            )


def _repeated_windows(
    block: Block, places_column, flags_column
) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the block's runs of repeated windows. Runs may overlap."""
    places = Places(block)
    settled = (_read_places(places_column, places) & _SETTLED) > 0
    settled &= places.high >= places.low
    low, high = places.low[settled], places.high[settled]
    # Only texts that got flags have their windows named.
    has = pc.is_valid(flags_column).to_numpy(zero_copy_only=False)
    counts = np.where(has, np.maximum(np.diff(block.offsets) - WINDOW + 1, 0), 0)
    if counts.any():
        first = np.append(0, np.cumsum(counts))
        some = counts > 0
        at = _ranges(block.offsets[:-1][some], (block.offsets[1:] - WINDOW)[some])
        keys = range_names(block.data, at, at + WINDOW, 4)
        at = at[M.read_flags(flags_column, keys, first, False)]
        low, high = np.concatenate([low, at]), np.concatenate([high, at])
    return low, high


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text"), BLOCK_BYTES):
            n = block.hi - block.lo
            part = batch.slice(block.lo, n)
            low, high = _repeated_windows(block, part.column("places"), part.column("flags"))
            cover = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(cover, low, _ONE)
            np.add.at(cover, high + WINDOW, -_ONE)
            gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = block.offsets[:-1][block.offsets[:-1] < len(gone)]
            begins[edges] = gone[edges]
            digests = []
            for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True):
                digests.append(hashlib.sha256(block.data[a:b][~gone[a:b]].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(block.offsets), pa.int64()),
                    pa.array(block.per_text(gone), pa.int64()),
                    pa.array(block.per_text(begins), pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _batches(rows: Iterator[dict], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    kinds = [pa.int32()] + [pa.binary()] * 8
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield M._batch(held, _NAMES, kinds)
            held = []
    if held:
        yield M._batch(held, _NAMES, kinds)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    texts = M.owned(docs, F.col("text").cast("string").alias("text"), "doc_id")
    found = texts.select("id", "hash", "text").mapInArrow(
        lambda it: _batches(_first_rows(it, n_buckets)), PLACES
    )
    verdicts = found.groupBy("bucket").applyInArrow(_sort_places, VERDICTS)
    verdicts = verdicts.groupBy("id", "hash").agg(
        F.collect_list(F.struct("keys", "codes", "mask")).alias("places")
    )
    placed = texts.join(verdicts.hint("shuffle_hash"), ["id", "hash"], "left")
    windows = placed.mapInArrow(
        lambda it: M.packed_batches(_second_rows(it, n_buckets)), M.PACKED
    )
    done = M.with_flags(placed, M.flags(windows, M.TWICE))
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    return done.mapInArrow(_results, schema)
