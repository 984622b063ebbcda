"""Prefix trie of conversations, as a z-fast trie in tables.

A conversation is the sequence of its turns (role and text). Equal beginnings are one
node of the trie; its compacted nodes are the root, the places where conversations
part, and those where one ends. Everything is a table, so no task holds a trie.

* A *prefix name* is 128 bits that stand for the first d turns: the exclusive or of
  the fingerprints of ``(d, turn)``. Two different prefixes get one name with a chance
  of 2**-128. Names of long conversations are made in blocks of turns, so none is
  worked on by one task.
* A compacted node covers the depths ``q + 1`` to ``e`` (its extent). It is found under
  its *handle*: the prefix name at the two-fattest number of that interval, the one
  that can be divided by the largest power of two.
* Conversations are inserted in batches. Each finds its exit node by fat binary search:
  it looks up its own prefix name at the two-fattest number of the interval that is
  left, which then goes on behind the extent found, or ends before the handle. That
  takes as many look-ups (joins) as the longest conversation's length has bits.
* A batch splits the edges that its conversations leave midway, and adds what they
  don't share with the trie. Places where the batch's own new ends part are counted by
  prefix name, with partial counts, so a first turn that most conversations share is no
  hot group.
* In the end edges are expanded: a row for every depth, with counts of all below it.

Equal conversations are one sequence from the start. What a subtree saves needs no
walk through the tree: with ``L`` the code points of a sequence, ``B`` those before a
node, and each node owned by its smallest member, it is the sum of ``L`` over all
members, less what the sequences below own, less ``(members - 1) B``.

Defined results: a null role or text is empty; turns are ordered by ``turn``, null
first, ties by the md5 of role and text; repeated rows are turns each; rows without a
``conv_id`` belong to no conversation; a conversation without turns ends at the root;
an empty table has no node. Extra columns are ignored. Texts of any length are only
hashed and measured, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import stored

#: Turns of one conversation whose prefix names are made by one task.
BLOCK_BITS = 12
#: One in so many sequences is in the first batch.
FIRST_BATCH = 8
#: Ids of one row of text on the way to a digest.
CHUNK_IDS = 4_096
HEADS, MOST_HEAD = 100, 6

KEY = ["d", "p1", "p2"]


# --- Turns ---------------------------------------------------------------------


def _number(turns: DataFrame) -> DataFrame:
    """``id, pos, name, chars``: turns counted from 1 within each conversation. Ranges of
    the sorted turns are numbered apart and then follow one another, so a conversation
    may lie in many tasks."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("name"),
        F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("id"), F.col("turn").asc_nulls_first(), F.col("name")]
    ranges = (
        slim.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id())
    )
    ranges = stored(ranges.drop("turn"), "turns")
    runs = ranges.groupBy("id", "part").agg(
        F.min("row").alias("low"), F.count(F.lit(1)).alias("n")
    )
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    pos = F.col("earlier") + F.col("row") - F.col("low") + 1
    return ranges.join(runs, ["id", "part"]).select("id", pos.alias("pos"), "name", "chars")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``id``) and their turns (``id, d, name, chars``), as they are."""
    rows = stored(_number(turns), "numbered")
    return rows.select("id").distinct(), rows.withColumnRenamed("pos", "d")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns after each took over the first ``h`` turns of its
    hundred's first one in place of its own, ``h`` being ``crc32(id) % 6``."""
    rows = stored(_number(turns), "numbered")
    sizes = rows.groupBy("id").agg(F.max("pos").alias("n"))
    convs = sizes.select(
        "id",
        (F.crc32(F.col("id").cast("string")) % MOST_HEAD).alias("h"),
        (F.col("id") - F.col("id") % HEADS).alias("head"),
    )
    heads = sizes.select(F.col("id").alias("head"), F.col("n").alias("most"))
    convs = convs.join(heads, "head", "left").select(
        "id", "head", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("taken")
    )
    convs = stored(convs, "conversations")
    first = rows.where(F.col("pos") < MOST_HEAD).select(
        F.col("id").alias("head"), "pos", "name", "chars"
    )
    copied = convs.join(first, "head").where("pos <= h").select(
        "id", F.col("pos").alias("d"), "name", "chars"
    )
    rest = rows.join(convs, "id").where("pos > h").select(
        "id", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "name", "chars"
    )
    return convs.select("id"), copied.unionByName(rest)


def _paths(turns: DataFrame) -> DataFrame:
    """``id, d, p1, p2, o1, o2, chars, sum``: prefix names at each depth and the one
    before, and code points so far."""
    rows = turns.select(
        "id",
        F.col("d").cast("int").alias("d"),
        "chars",
        F.xxhash64("d", "name").alias("x1"),
        F.xxhash64(F.lit("turn"), "name", "d").alias("x2"),
        F.shiftright(F.col("d").cast("int") - 1, BLOCK_BITS).alias("block"),
    )
    rows = stored(rows, "named")
    run = Window.partitionBy("id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select(
        *("id", "d", "chars", "block", "x1", "x2"),
        F.bit_xor("x1").over(run).alias("b1"),
        F.bit_xor("x2").over(run).alias("b2"),
        F.sum("chars").over(run).alias("s"),
    )
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("id", "block").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("chars").alias("s")
    )
    zero = F.lit(0).cast("bigint")
    blocks = blocks.select(
        "id",
        "block",
        F.coalesce(F.bit_xor("x1").over(before), zero).alias("c1"),
        F.coalesce(F.bit_xor("x2").over(before), zero).alias("c2"),
        F.coalesce(F.sum("s").over(before), zero).alias("cs"),
    )
    p1, p2 = F.col("b1").bitwiseXOR(F.col("c1")), F.col("b2").bitwiseXOR(F.col("c2"))
    return inner.join(blocks, ["id", "block"]).select(
        "id",
        "d",
        p1.alias("p1"),
        p2.alias("p2"),
        p1.bitwiseXOR(F.col("x1")).alias("o1"),
        p2.bitwiseXOR(F.col("x2")).alias("o2"),
        "chars",
        (F.col("s") + F.col("cs")).alias("sum"),
    )


# --- Ends ----------------------------------------------------------------------


_CHUNK = "d int, p1 bigint, p2 bigint, low bigint, listed string"
_DIGEST = "d int, p1 bigint, p2 bigint, ends string"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _batches(rows: Iterator[tuple], columns: str, at_once: int = 128) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])
    while held := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
            schema=schema,
        )


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Sorted ids of a node, joined to texts of ``most`` at most."""
    key, ids = None, []
    for *new, i in _rows(batches, *KEY, "id"):
        if ids and (new != key or len(ids) >= most):
            yield (*key, ids[0], ",".join(map(str, ids)))
            ids = []
        key = new
        ids.append(i)
    if ids:
        yield (*key, ids[0], ",".join(map(str, ids)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One pass over the sorted texts of each node, one at a time."""
    key, state = None, None
    for *new, listed in _rows(batches, *KEY, "listed"):
        if new != key:
            if key is not None:
                yield (*key, state.hexdigest())
            key, state = new, hashlib.sha256()
        else:
            state.update(b",")
        state.update(listed.encode())
    if key is not None:
        yield (*key, state.hexdigest())


def ends_digests(ends: DataFrame) -> DataFrame:
    """``d, p1, p2, ends``: SHA-256 of the node's ids, ascending, joined by commas. A
    digest is made in one piece, so a node's ids meet in one task, in text of many ids
    a row and without being held; they are sorted in ranges before."""
    order, most = [*KEY, "id"], CHUNK_IDS
    listed = (
        ends.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda it: _batches(_chunks(it, most), _CHUNK), _CHUNK)
    )
    return (
        listed.repartition(*KEY)
        .sortWithinPartitions(*KEY, "low")
        .mapInArrow(lambda it: _batches(_digests(it), _DIGEST), _DIGEST)
    )


# --- The trie ------------------------------------------------------------------


def two_fattest(a: Column, b: Column) -> Column:
    """The number in ``(a, b]`` that the largest power of two divides."""
    zeros = F.length(F.bin(a.bitwiseXOR(b).cast("bigint"))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1), zeros))


def _handled(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes ``e, p1, p2, q, rep`` with handle ``f, h1, h2`` and the name ``g1, g2`` of
    their edge's first place, all read from the path of ``rep``, which goes through
    them."""
    nodes = nodes.withColumn("f", two_fattest(F.col("q"), F.col("e")))
    at = lambda d, one, two: paths.select(
        F.col("id").alias("rep"), F.col("d").alias(d), F.col("p1").alias(one), F.col("p2").alias(two)
    )
    nodes = nodes.withColumn("g", F.col("q") + 1)
    return nodes.join(at("f", "h1", "h2"), ["rep", "f"]).join(at("g", "g1", "g2"), ["rep", "g"])


def exits(nodes: DataFrame, batch: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """``id, n, l, e, p1, p2``: how far each sequence of the batch goes along with the
    trie, and its exit node."""
    handles = nodes.select("f", "h1", "h2", F.col("e").alias("found"))
    own = paths.select("id", F.col("d").alias("f"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    state = batch.select("id", "n", F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("at"))
    for _ in range(longest.bit_length()):
        f = F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b")))
        state = (
            state.withColumn("f", f)
            .join(own, ["id", "f"], "left")
            .join(handles, ["f", "h1", "h2"], "left")
        )
        hit, live = F.col("found").isNotNull(), F.col("f").isNotNull()
        state = state.select(
            "id",
            "n",
            F.when(hit, F.col("found")).otherwise(F.col("a")).alias("a"),
            F.when(live & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            # Where the last node found has its handle.
            F.when(hit, F.col("f")).otherwise(F.col("at")).alias("at"),
        )
    state = stored(state, "found")
    # The node found last, then its child in the sequence's direction, if there is one.
    by_handle = nodes.select(F.col("f").alias("at"), "h1", "h2", "e", "p1", "p2", "q", "rep")
    last = state.join(own.withColumnRenamed("f", "at"), ["id", "at"]).join(
        by_handle, ["at", "h1", "h2"]
    )
    last = last.select("id", "n", "e", "p1", "p2", "q", "rep")
    by_edge = nodes.select(
        "g", "g1", "g2", *(F.col(c).alias(f"c_{c}") for c in ("e", "p1", "p2", "q", "rep"))
    )
    ahead = paths.select("id", F.col("d").alias("g"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    last = (
        last.withColumn("g", F.col("e") + 1)
        .join(ahead, ["id", "g"], "left")
        .join(by_edge, ["g", "g1", "g2"], "left")
    )
    child = F.col("c_e").isNotNull()
    last = last.select(
        "id", "n", *(F.when(child, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in ("e", "p1", "p2", "q", "rep"))
    )
    last = stored(last, "last")
    # How far it goes along that node's edge.
    edge = last.select("id", "rep", F.explode(F.sequence(F.col("q") + 1, F.least("n", "e"))).alias("d"))
    mine = paths.select("id", "d", F.col("p1").alias("m1"), F.col("p2").alias("m2"))
    theirs = paths.select(F.col("id").alias("rep"), "d", "p1", "p2")
    same = edge.join(mine, ["id", "d"]).join(theirs, ["rep", "d"]).where("m1 = p1 AND m2 = p2")
    far = same.groupBy("id").agg(F.max("d").alias("l"))
    return last.join(far, "id", "left").select(
        "id", "n", F.coalesce("l", "q").alias("l"), "e", "p1", "p2"
    )


def insert(nodes: DataFrame, left: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie's nodes after the sequences that leave it as ``left`` says."""
    left = stored(left, "exits")
    new = stored(
        paths.join(left.select("id", "l"), "id").where("d > l").select("id", "l", *KEY, "o1", "o2"),
        "tails",
    )
    # New places where sequences part or end.
    places = new.groupBy(*KEY).agg(F.min("o1").alias("o1"), F.min("o2").alias("o2"))
    forks = (
        places.groupBy((F.col("d") - 1).alias("d"), F.col("o1").alias("p1"), F.col("o2").alias("p2"))
        .agg(F.count(F.lit(1)).alias("ways"))
        .where("ways > 1")
        .select(*KEY)
    )
    ends = left.where("n > l").select("id", F.col("n").alias("d"))
    ends = ends.join(new, ["id", "d"]).select(*KEY)
    marked = forks.union(ends).distinct()
    above = Window.partitionBy("id").orderBy("d")
    added = (
        new.join(marked, KEY)
        .withColumn("q", F.coalesce(F.lag("d").over(above), F.col("l")))
        .groupBy(*KEY)
        .agg(F.min("q").alias("q"), F.min("id").alias("rep"))
        .select(F.col("d").alias("e"), "p1", "p2", "q", "rep")
    )
    # Edges that are left midway are cut there.
    own = ["e", "p1", "p2"]
    cuts = left.where("l < e").select(*own, "l").distinct().join(nodes.select(*own, "q", "rep"), own)
    cuts = stored(cuts, "cuts")
    along = Window.partitionBy(*own).orderBy("l")
    halves = cuts.withColumn("q", F.coalesce(F.lag("l").over(along), F.col("q"))).select(
        F.col("l").alias("d"), "q", "rep"
    )
    halves = halves.join(
        paths.select(F.col("id").alias("rep"), *KEY), ["rep", "d"]
    ).select(F.col("d").alias("e"), "p1", "p2", "q", "rep")
    lower = cuts.groupBy(*own).agg(F.max("l").alias("cut"))
    kept = nodes.select(*own, "q", "rep").join(lower, own, "left").select(
        *own, F.coalesce("cut", "q").alias("q"), "rep"
    )
    columns = [*own, "q", "rep"]
    every = kept.select(columns).union(halves.select(columns)).union(added.select(columns))
    return stored(_handled(every, paths), "trie")


def trie(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """Compacted nodes of all ``sequences`` (``id, n``): ``e, p1, p2`` (extent), ``q``,
    ``rep`` and their handles."""
    longest = sequences.agg(F.max("n"), F.min("id")).first()
    zero = F.lit(0).cast("bigint")
    root = sequences.agg(F.min("id").alias("rep")).select(
        F.lit(0).alias("e"), zero.alias("p1"), zero.alias("p2"), F.lit(-1).alias("q"), "rep"
    )
    nodes = stored(_handled(root, paths), "trie")
    early = F.pmod(F.xxhash64("id"), F.lit(FIRST_BATCH)) == 0
    # The first batch meets a trie that is nothing but its root.
    alone = sequences.where(early).select(
        "id", "n", F.lit(0).alias("l"), F.lit(0).alias("e"), zero.alias("p1"), zero.alias("p2")
    )
    nodes = insert(nodes, alone, paths)
    rest = sequences.where(~early)
    return insert(nodes, exits(nodes, rest, paths, longest[0] or 0), paths)


# --- What a user gets ------------------------------------------------------------


def nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of conversations ``id`` with turns
    ``id, d, name, chars``: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    every = stored(_paths(turns), "paths")
    zero = F.lit(0).cast("bigint")
    # Where each conversation ends: its whole sequence.
    tips = every.groupBy("id").agg(F.max("d").alias("d"))
    tips = every.join(tips, ["id", "d"]).select("id", *KEY, "sum")
    ends = convs.join(tips, "id", "left").select(
        "id",
        F.coalesce("d", F.lit(0)).alias("d"),
        *(F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "sum")),
    )
    ends = stored(ends, "ends")
    seqs = stored(
        ends.groupBy(*KEY).agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.min("sum").alias("total")
        ),
        "sequences",
    )
    own = every.join(seqs.select("id"), "id", "left_semi")
    roots = seqs.select(
        "id", F.lit(0).alias("d"), *(zero.alias(c) for c in ("p1", "p2", "o1", "o2", "chars", "sum"))
    )
    paths = stored(own.select(roots.columns).union(roots), "places")
    compact = trie(seqs.select("id", F.col("d").alias("n")), paths)

    # Each node's parent, read from a path through it.
    at = paths.select(F.col("id").alias("rep"), F.col("d").alias("q"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    tree = stored(
        compact.select("e", "p1", "p2", "q", "rep").join(at, ["rep", "q"], "left").drop("rep"), "tree"
    )
    up = ["q", "u1", "u2"]
    children = tree.where("q >= 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("q").alias("d"), F.col("u1").alias("p1"), F.col("u2").alias("p2"), "n_children")
    childless = seqs.join(children.select(*KEY), KEY, "left_anti").select("id", F.lit(1).alias("leaf"))
    known = seqs.select("id", "size", "total").join(childless, "id", "left")
    # Sequences by the nodes that they go through.
    extents = tree.select(F.col("e").alias("d"), "p1", "p2", "q")
    through = stored(paths.select("id", *KEY).join(extents, KEY).join(known, "id"), "through")
    members = through.groupBy(*KEY).agg(
        F.min("id").alias("conv"),
        F.min("q").alias("q"),
        F.sum("size").alias("n_convs"),
        F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
        F.sum(F.col("size") * F.col("total")).alias("all_chars"),
        F.min(F.struct("id", "total")).getField("total").alias("first_chars"),
    )
    members = stored(members, "members")
    # What a sequence owns begins where it becomes the smallest member.
    begins = members.groupBy(F.col("conv").alias("id")).agg(F.min("q").alias("d"))
    before = begins.join(paths.select("id", "d", "sum"), ["id", "d"], "left").select(
        "id", F.coalesce("sum", zero).alias("before")
    )
    owned = known.join(before, "id").select("id", (F.col("total") - F.col("before")).alias("owned"))
    below = (
        through.select("id", *KEY)
        .join(members.select(*KEY, "conv"), KEY)
        .where("id <> conv")
        .join(owned, "id")
        .groupBy(*KEY)
        .agg(F.sum("owned").alias("others"))
    )
    facts = (
        members.join(below, KEY, "left")
        .join(children, KEY, "left")
        .join(ends_digests(ends.select("id", *KEY)), KEY, "left")
        .join(tree.select(F.col("e").alias("d"), "p1", "p2", "u1", "u2"), KEY)
    )
    parents = members.select(
        F.col("d").alias("q"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv").alias("parent")
    )
    facts = facts.join(parents, up, "left").select(
        F.col("conv").alias("id"),
        F.col("d").alias("e"),
        "q",
        "parent",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        (F.col("all_chars") - F.coalesce("others", zero) - F.col("first_chars")).alias("kept"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends"),
    )
    # Edges expanded: a row for every depth.
    rows = facts.select("*", F.explode(F.sequence(F.col("q") + 1, F.col("e"))).alias("d"))
    rows = rows.join(paths.select("id", "d", (F.col("sum") - F.col("chars")).alias("before")), ["id", "d"])
    at_end = F.col("d") == F.col("e")
    return rows.select(
        F.col("id").alias("conv_id"),
        F.col("d").cast("bigint").alias("depth"),
        F.when(F.col("d") == F.col("q") + 1, F.col("parent")).otherwise(F.col("id")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        (F.col("kept") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(at_end, F.col("ends")).otherwise(hashlib.sha256().hexdigest()).alias("ends_sha256"),
    )
