"""N-gram Jaccard join with a token-group matrix.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
are linked; components of links are returned. Equal sets are one class from the
start, so copies are never compared.

A set's *head* is its rarest shingles: ``n - ceil(0.8 n) + EXTRA`` of them, in an
order that all sets share (a count sketch of fixed size, then the hash). Two sets
that link have at least ``min(EXTRA, ceil(0.8 n))`` head shingles in common, ``n``
being the smaller size. The matrix holds, for each group of similar documents, the
union of its members' heads; the number of a query's head shingles in it bounds the
overlap with every member, and only groups that reach the bound are opened, which
means comparing the query's whole set with the members'. Documents of one component
are never compared: only components are made, not all links, and a document's number
of links is not known.

1. Documents that have their least shared shingle in common form a group around one
   leader, and each is compared with it.
2. Each document opens the largest other component that has enough of its head.
3. All pairs of groups with enough in common are opened where they belong to more
   than one component: no link is lost.

In the last step groups are first put together that have much in common, so a large
group of near copies meets itself once, and bitmaps of the sets are compared before
sets: the bits that only one of two has bound their overlap.

Defined results: null and empty texts and texts without words have an empty set and
link with nothing; a null id is larger than any other; rows with one id are compared
like others; repeated rows get the same result; an empty table gives an empty one.
Extra columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm import match as M
from gradus.llm.blocks import (
    LOWER,
    Block,
    blocks,
    mix,
    owners,
    range_names,
    squeezed,
    unsqueezed,
    windows,
)
from gradus.llm.common import buckets_for, stored, stored_by, text_bytes
from gradus.llm.components import components

SHINGLE = 5
PERCENT = 80
EXTRA = 8
#: Counters of the sketch: a power of two up to 2**24, one byte each when sent.
SKETCH_BITS = (16, 24)
SLICE_BITS = 14
BUCKET_BYTES = 48 << 20
#: Shingles that one side of a cell of comparisons holds (or one longer set).
CELL_SHINGLES = 200_000
#: Bits of a set's bitmap, and bitmaps on one side of a cell.
BITS = 8192
CELL_BITMAPS = 2_000


def least_common(n):
    """Least intersection with a set of ``n`` shingles at the similarity asked for."""
    return (PERCENT * n + 99) // 100


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and each text's first."""
    data = LOWER[block.data]
    starts, ends, first = block.words()
    names = range_names(data, starts, ends)
    keys, at = windows(names, first, SHINGLE)
    text = owners(first)[at]
    for k in range(1, SHINGLE):  # the whole text where it is shorter
        short = np.flatnonzero(np.diff(first) == k)
        if len(short):
            more, start = windows(names, first, k, k)
            whole = np.isin(start, first[short])
            own = owners(first)[start[whole]]
            right = np.diff(first)[own] == k
            keys = np.concatenate([keys, more[whole][right]])
            text = np.concatenate([text, own[right]])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(block.hi - block.lo + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            keys, first = shingle_sets(block)
            part = batch.slice(block.lo, block.hi - block.lo)
            s1 = _sums(mix(keys + np.uint64(1)), first).view(np.int64)
            s2 = _sums(mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("hash"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(s1),
                    pa.array(s2),
                ],
                ["id", "hash", "n", "s1", "s2"],
            )


def _sketch_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the task's shingles, only where there are any."""
    table = np.zeros(1 << bits, np.uint32)
    for batch in batches:
        for block in blocks(batch.column("text")):
            keys, _ = shingle_sets(block)
            cell, count = np.unique(keys >> np.uint64(64 - bits), return_counts=True)
            table[cell] += count.astype(np.uint32)
    for i in range(len(table) >> SLICE_BITS):
        part = table[i << SLICE_BITS : (i + 1) << SLICE_BITS]
        used = np.flatnonzero(part)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i], pa.int32()),
                    pa.array([squeezed(np.diff(used, prepend=0))]),
                    pa.array([squeezed(part[used])]),
                ],
                ["slice", "cells", "counts"],
            )


def _sketch_slice(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLICE_BITS, np.uint64)
    for cells, counts in zip(group["cells"], group["counts"], strict=True):
        total[np.cumsum(unsqueezed(cells.as_py()))] += unsqueezed(counts.as_py())
    # Powers of two are enough to tell rare from frequent.
    level = np.ceil(np.log2(total + np.uint64(1))).astype(np.uint8)
    return pa.table([group["slice"].slice(0, 1), pa.array([level.tobytes()])], ["slice", "levels"])


def sketch(docs: DataFrame, n_bytes: int) -> np.ndarray:
    """Frequency level of each sketch cell: at most 16 MB, whatever the input."""
    low, high = SKETCH_BITS
    bits = min(max(int(n_bytes // 8).bit_length(), low), high)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _sketch_rows(it, bits), "slice int, cells binary, counts binary"
    )
    slices = rows.groupBy("slice").applyInArrow(_sketch_slice, "slice int, levels binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in slices.collect():
        lo = row["slice"] << SLICE_BITS
        out[lo : lo + (1 << SLICE_BITS)] = np.frombuffer(row["levels"], np.uint8)
    return out


def heads(keys: np.ndarray, first: np.ndarray, levels: np.ndarray):
    """Heads of the sets of a block, in order of text; each text's first."""
    bits = len(levels).bit_length() - 1
    text = owners(first)
    n = np.diff(first)
    length = np.minimum(n, n - least_common(n) + EXTRA)
    order = np.lexsort((keys, levels[keys >> np.uint64(64 - bits)], text))
    rank = np.arange(len(keys)) - first[:-1][text]
    order = order[rank < length[text]]
    out = np.zeros(len(first), np.int64)
    np.cumsum(length, out=out[1:])
    return keys[order], out


def _head_rows(batches, levels, n_buckets: int):
    for batch in batches:
        for block in blocks(batch.column("text")):
            keys, first = heads(*shingle_sets(block), levels.value)
            part = batch.slice(block.lo, block.hi - block.lo)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            hashes = part.column("hash").to_numpy(zero_copy_only=False)
            # The text's hash tells owners apart: ids may repeat.
            yield from M.pack(hashes, ids, first, keys, n_buckets, M.SHARED)


def _bitmap(keys: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(keys & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _active_rows(batches, levels) -> Iterator[pa.RecordBatch]:
    """Sets whose head has enough shared shingles to link at all."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            n_texts = block.hi - block.lo
            part = batch.slice(block.lo, n_texts)
            keys, first = shingle_sets(block)
            head, at = heads(keys, first, levels.value)
            shared = M.read_flags(part.column("flags"), head, at, True)
            n = np.diff(first)
            hits = np.bincount(owners(at)[shared], minlength=n_texts)
            keep = np.flatnonzero((n > 0) & (hits >= np.minimum(EXTRA, least_common(n))))
            tokens = [head[at[d] : at[d + 1]][shared[at[d] : at[d + 1]]] for d in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node").take(pa.array(keep)),
                    pa.array(n[keep], pa.int64()),
                    pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())),
                    pa.array([keys[first[d] : first[d + 1]].tobytes() for d in keep], pa.binary()),
                    pa.array([_bitmap(keys[first[d] : first[d + 1]]) for d in keep], pa.binary()),
                ],
                ["node", "n", "tokens", "set", "bits"],
            )


def _compare(group: pa.Table) -> pa.Table:
    """Links between the queries and the members of a cell. Overlaps with all members
    are counted at once, from an inverted index. Of components that are linked
    already, here or before, no further links are sought."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["set"]]
    nodes, parts = group["node"].to_pylist(), group["component"].to_pylist()
    is_query = np.array(group["query"].to_pylist(), bool)
    members = np.flatnonzero(~is_query)
    sizes = np.array([len(sets[i]) for i in members], np.int64)
    tokens = np.concatenate([sets[i] for i in members] or [np.zeros(0, np.uint64)])
    holder = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    found = []
    for i in np.flatnonzero(is_query):
        n = len(sets[i])
        lo = np.searchsorted(tokens, sets[i], "left")
        count = np.searchsorted(tokens, sets[i], "right") - lo
        held = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count)
        both = np.bincount(holder[held + np.arange(len(held))], minlength=len(members))
        for j in np.flatnonzero(100 * both >= PERCENT * (n + sizes - both)):
            a, b = find(parts[i]), find(parts[members[j]])
            if a != b:
                root[a] = b
                found.append((nodes[i], nodes[members[j]]))
    return pa.table(
        [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]
    )


def _cells(
    sets: DataFrame, queries: DataFrame, members: DataFrame, weight: Column, most: int
) -> DataFrame:
    """Both sides of each pair with the columns of ``sets``, dealt to cells ``pair, q,
    m``: each holds one block of queries and one of members, of about ``most``."""
    sizes = sets.select("node", "n")
    parts = F.ceil(weight / most).cast("int")

    def cut(side: DataFrame, name: str) -> DataFrame:
        return side.join(sizes, "node").groupBy("pair").agg(parts.alias(name))

    cells = stored(cut(queries, "qs").join(cut(members, "ms"), "pair"), "cells")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["pair", "node", "component"]
    asked = queries.join(cells, "pair").select(
        *columns, F.lit(True).alias("query"), block("qs").alias("q"), every("ms").alias("m")
    )
    held = members.join(cells, "pair").select(
        *columns, F.lit(False).alias("query"), every("qs").alias("q"), block("ms").alias("m")
    )
    return asked.union(held).join(sets, "node")


def opened(sets: DataFrame, queries: DataFrame, members: DataFrame) -> DataFrame:
    """Links ``a, b`` between the queries and the members of each ``pair`` (both
    ``pair, node, component``; ``pair`` is the group opened)."""
    rows = _cells(
        sets.select("node", "n", "set"), queries, members, F.sum("n"), CELL_SHINGLES
    )
    return rows.groupBy("pair", "q", "m").applyInArrow(_compare, "a bigint, b bigint")


def _need(n):
    return F.least(F.lit(EXTRA), F.ceil(F.lit(PERCENT) * n / 100)).cast("int")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after links between documents."""
    ends = (
        links.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
        .join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        .where("a <> b")
    )
    roots = components(ends).select(F.col("node").alias("component"), "root")
    out = parts.join(roots, "component", "left").select(
        "node", F.coalesce("root", "component").alias("component")
    )
    return stored(out, "parts")


def _doubtful(
    active: DataFrame, queries: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Queries and members that may link by their bitmaps."""
    doubt = _cells(
        active.select("node", "n", "bits"), queries, members, F.count(F.lit(1)), CELL_BITMAPS
    )
    doubt = doubt.groupBy("pair", "q", "m").applyInArrow(_promise, "pair bigint, node bigint")
    doubt = stored(doubt.distinct(), "doubt")
    left = lambda side: side.join(doubt, ["pair", "node"], "left_semi")
    return left(queries), left(members)


def _to_leaders(active: DataFrame, keys: DataFrame) -> DataFrame:
    """Each document against the leader of its group."""
    own = F.col("node").alias("component")
    queries = keys.where("node <> g").select(F.col("g").alias("pair"), "node", own)
    leaders = queries.select("pair", F.col("pair").alias("node")).distinct()
    links = opened(active, *_doubtful(active, queries, leaders.select("pair", "node", own)))
    return _merged(keys.select("node", own), stored(links, "found"))


def _to_largest(active: DataFrame, tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """Each document against the largest component that has enough of its head."""
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = stored(tokens.join(parts.join(size, "component"), "node"), "matrix")
    top = rows.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"))
    pairs = rows.join(top, "token").where("component <> top.component")
    enough = (
        pairs.groupBy("node", "component", F.col("top.component").alias("pair"))
        .agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        .where(F.col("c") >= _need(F.col("n")))
    )
    best = enough.groupBy("node", "component").agg(
        F.max_by("pair", F.struct("c", "pair")).alias("pair")
    )
    queries = stored(best.select("pair", "node", "component"), "openings")
    members = parts.join(
        queries.select(F.col("pair").alias("component")).distinct(), "component", "left_semi"
    ).select(F.col("component").alias("pair"), "node", "component")
    return _merged(parts, stored(opened(active, *_doubtful(active, queries, members)), "found"))


def _alike(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """``node, g`` after groups were put together that have half of one's union in
    common, so that a large group of near copies is one group."""
    union = stored(tokens.join(keys, "node").select("token", "g").distinct(), "unions")
    sizes = union.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    rows = union.join(sizes, "g")
    top = rows.groupBy("token").agg(F.max(F.struct("size", "g")).alias("top"))
    near = (
        rows.join(top, "token")
        .where("g <> top.g")
        .groupBy(F.col("g").alias("a"), F.col("top.g").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size"))
        .where("2 * c >= size")
    )
    roots = components(stored(near.select("a", "b"), "near"))
    out = keys.join(roots.select(F.col("node").alias("g"), "root"), "g", "left")
    return stored(out.select("node", F.coalesce("root", "g").alias("g")), "alike")


def _promise(group: pa.Table) -> pa.Table:
    """Documents of a cell that may link with one of another component. A bit that
    one bitmap has and the other lacks stands for a shingle that only one has."""
    if group.num_rows == 0:
        return pa.table([pa.array([], pa.int64())] * 2, ["pair", "node"])
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint64)
    bits = bits.reshape(group.num_rows, -1)
    n = group["n"].to_numpy()
    component = group["component"].to_numpy()
    query = np.array(group["query"].to_pylist(), bool)
    members = np.flatnonzero(~query)
    hit = np.zeros(group.num_rows, bool)
    for i in np.flatnonzero(query):
        near = members[
            (component[members] != component[i])
            & (100 * n[members] >= PERCENT * n[i])
            & (100 * n[i] >= PERCENT * n[members])
        ]
        if not len(near):
            continue
        other = bits[near]
        only = np.bitwise_count(bits[i] & ~other).sum(1)
        theirs = np.bitwise_count(other & ~bits[i]).sum(1)
        most = np.minimum(n[i] - only.astype(np.int64), n[near] - theirs.astype(np.int64))
        may = near[100 * most >= PERCENT * (n[i] + n[near] - most)]
        hit[may] = True
        hit[i] |= len(may) > 0
    at = pa.array(np.flatnonzero(hit))
    return pa.table([group["pair"].take(at), group["node"].take(at)], ["pair", "node"])


def _to_all(
    active: DataFrame, tokens: DataFrame, keys: DataFrame, parts: DataFrame
) -> DataFrame:
    """All groups that may still hold a link between components. Bitmaps are
    compared first; only sets that they leave in doubt are sent."""
    groups = stored(_alike(tokens, keys).join(parts, "node"), "groups")
    sizes = active.select("node", "n")
    about = stored(
        groups.join(sizes, "node").groupBy("g").agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.min("component").alias("x"),
            F.max("component").alias("y"),
        ),
        "about",
    )
    union = stored(
        tokens.join(groups, "node").select("token", "g").distinct().join(about, "g"), "matrix"
    )
    one, two = union.alias("s"), union.alias("t")
    open_ = (F.col("s.x") != F.col("t.y")) | (F.col("s.y") != F.col("t.x"))
    fit = (100 * F.col("s.most") >= PERCENT * F.col("t.least")) & (
        100 * F.col("t.most") >= PERCENT * F.col("s.least")
    )
    met = one.join(
        two, (F.col("s.token") == F.col("t.token")) & (F.col("s.g") <= F.col("t.g")) & open_ & fit
    )
    pairs = (
        met.groupBy(F.col("s.g").alias("g1"), F.col("t.g").alias("g2"))
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.first(F.least("s.least", "t.least")).alias("n"),
        )
        .where(F.col("c") >= _need(F.col("n")))
        .select("g1", "g2")
    )
    pairs = stored(pairs, "openings")
    # A group is opened once, for the documents of all groups that qualify.
    queries = pairs.join(groups, F.col("g1") == F.col("g")).select(
        F.col("g2").alias("pair"), "node", "component"
    )
    members = groups.join(
        pairs.select(F.col("g2").alias("g")).distinct(), "g", "left_semi"
    ).select(F.col("g").alias("pair"), "node", "component")
    return _merged(parts, stored(opened(active, *_doubtful(active, queries, members)), "found"))


def linked_groups(active: DataFrame, n_buckets: int) -> DataFrame:
    """``node, component`` of every set that may link. ``active`` lies in so many buckets
    of ``node``."""
    tokens = stored_by(
        active.select("node", "n", F.explode("tokens").alias("token")).distinct(),
        "tokens",
        "node",
        n_buckets,
        dealt=True,
    )
    keys = tokens.groupBy("node").agg(F.min("token").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("g"))
    keys = stored(keys.join(leaders, "key").select("node", "g"), "keys")
    parts = _to_leaders(active, keys)
    parts = _to_largest(active, tokens, parts)
    return _to_all(active, tokens, keys, parts)


def classes(docs: DataFrame) -> DataFrame:
    """``id, hash, n_shingles, component, keeper`` of every row: the component's
    smallest id, and whether the row's id and text are its smallest."""
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    texts = M.owned(docs, F.col("text").cast("string").alias("text"))
    rows = stored(
        texts.mapInArrow(_set_rows, "id bigint, hash bigint, n bigint, s1 bigint, s2 bigint"),
        "sets",
    )
    same = ["n", "s1", "s2"]
    named = stored(
        rows.where("n > 0")
        .groupBy(*same)
        .agg(F.min(F.struct("id", "hash")).alias("least"))
        .select(*same, "least.*", F.monotonically_increasing_id().alias("node")),
        "classes",
    )
    levels = spark.sparkContext.broadcast(sketch(docs, n_bytes))
    # Heads are a quarter of all shingles.
    n_buckets = buckets_for(n_bytes, 4 * BUCKET_BYTES)
    owners_ = named.select("id", "hash", "node").hint("shuffle_hash")
    reps = texts.join(owners_, ["id", "hash"])
    found = reps.mapInArrow(
        lambda it: M.packed_batches(_head_rows(it, levels, n_buckets)), M.PACKED
    )
    shared = M.flags(found, M.SHARED).select(
        F.col("hash").alias("id"), F.col("id").alias("hash"), "flags"
    )
    # Texts without a shared shingle in their head link with nothing.
    reps = reps.join(shared.hint("shuffle_hash"), ["id", "hash"])
    active = stored_by(
        reps.mapInArrow(
            lambda it: _active_rows(it, levels),
            "node bigint, n bigint, tokens array<bigint>, set binary, bits binary",
        ),
        "active",
        "node",
        n_buckets,
    )
    groups = linked_groups(active, n_buckets)
    # Classes outside all groups are components of their own.
    part = named.join(groups, "node", "left").select(
        *same, "id", "hash", F.coalesce("component", "node").alias("g")
    )
    least = part.groupBy("g").agg(F.min(F.struct("id", "hash")).alias("least"))
    ends = part.join(least, "g").select(*same, "least")
    out = rows.join(ends, same, "left")
    keeper = F.col("least").isNull() | (F.col("least") == F.struct("id", "hash"))
    return out.select(
        "id",
        "hash",
        F.col("n").alias("n_shingles"),
        F.coalesce("least.id", "id").alias("component"),
        keeper.alias("keeper"),
    )


def components_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    null = F.lit(int(M.NULL_ID))
    kind = docs.schema["doc_id"].dataType
    given = lambda c: F.when(F.col(c) != null, F.col(c)).cast(kind)
    return classes(docs.select("doc_id", "text")).select(
        given("id").alias("doc_id"), "n_shingles", given("component").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its
    columns. Texts without words stay."""
    kept = classes(docs.select("doc_id", "text")).where("keeper")
    kept = kept.groupBy("id", "hash").agg(F.max("n_shingles").alias("n"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]
    joined = M.owned(docs, *columns).join(kept.hint("shuffle_hash"), ["id", "hash"])
    # Repeated rows are a group too; texts without words are in none.
    again = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))
    once = joined.withColumn("again", again).where("again = 1 OR n = 0")
    return once.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
