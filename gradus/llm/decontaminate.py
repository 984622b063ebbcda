"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search, made of DataFrame functions only. An
item's MinHash is the set of its smallest shingle hashes; items are partitioned by
size (powers of two), and each partition has its own sketch size and number of hits
that a document must have:

    an item of n shingles that is contained to the share t lacks at most
    floor((1 - t) * n) of them, so of any k of its shingles a containing document
    has at least k - floor((1 - t) * n).

So no containing document is missed, however long it is. A document gives up its
shingle hashes below the largest sketch value, which meet the sketches in an
equi-join; pairs with enough hits are then verified on the shingles themselves.

Shingles are five consecutive words with A-Z lower-cased. Defined results: null and
empty texts and items, and items of fewer than five words, match nothing; null ids
are ids like any other; repeated rows give one pair, with the largest containment;
empty tables give no pairs. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import stored

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of at most so many values are sent to every executor (16 MB).
BROADCAST_VALUES = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array without any."""
    plain = F.btrim(F.translate(text, _UPPER, _UPPER.lower()), F.lit(_SPACE))
    return F.when(F.length(plain) > 0, F.split(plain, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def _starts(array: str) -> Column:
    """The first element of every shingle."""
    n = F.greatest(F.size(array) - (SHINGLE - 1), F.lit(0))
    return F.slice(F.col(array), F.lit(1), n)


def shingle_hashes(hashes: str) -> Column:
    """Hash of each shingle, from the array of word hashes."""
    return F.transform(
        _starts(hashes),
        lambda h, i: F.xxhash64(h, *(F.get(F.col(hashes), i + j) for j in range(1, SHINGLE))),
    )


def shingle_texts(tokens: str) -> Column:
    """The distinct shingles as text, from the array of words."""
    joined = F.transform(
        _starts(tokens),
        lambda w, i: F.concat_ws(
            " ", w, *(F.get(F.col(tokens), i + j) for j in range(1, SHINGLE))
        ),
    )
    return F.array_distinct(joined)


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``hashes`` of the shingles."""
    named = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    return named.select(*keep, shingle_hashes("_h").alias("hashes"))


def _missing(n: Column, threshold: float) -> Column:
    """Most shingles that a contained item can lack. Whole numbers only."""
    return F.floor((F.lit(100 - round(threshold * 100)) * n) / F.lit(100))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per item and sketch value: ``item, hash, need``."""
    sized = _hashed(items, "item").select(
        "item", F.array_distinct("hashes").alias("hashes")
    )
    sized = sized.withColumn("n", F.size("hashes")).where("n > 0")
    # Sizes from 2**p to 2**(p + 1) - 1 form a partition.
    low = F.expr("shiftleft(1, length(bin(n)) - 1)")
    wanted = F.lit(1) + F.floor(low / 16)
    k = F.least(_missing(2 * low - 1, threshold) + wanted, F.col("n")).cast("int")
    picked = sized.select(
        "item",
        (k - _missing(F.col("n"), threshold)).cast("int").alias("need"),
        F.slice(F.array_sort("hashes"), F.lit(1), k).alias("sketch"),
    )
    return picked.select("item", "need", F.explode("sketch").alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs ``doc_id, item`` with enough sketch values in common."""
    held = sketch.agg(F.max("hash"), F.count(F.lit(1))).first()
    if held[0] is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item bigint"
        )
    low = F.filter("hashes", lambda h: h <= F.lit(held[0]))
    rows = _hashed(docs, "doc_id").select(
        "doc_id", F.explode(F.array_distinct(low)).alias("hash")
    )
    if held[1] <= BROADCAST_VALUES:
        sketch = F.broadcast(sketch)
    hits = rows.join(sketch, "hash").groupBy("doc_id", "item")
    # Rows with one id count together here; the check below parts them.
    return (
        hits.agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need"))
        .where("hits >= need")
        .select("doc_id", "item")
    )


def contained(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` of the pairs found."""
    texts = docs.select("doc_id", words(F.col("text")).alias("words"))
    named = (
        items.select("item_id", "text")
        .distinct()
        .select(
            "item_id",
            F.xxhash64(F.col("item_id"), F.col("text")).alias("item"),
            words(F.col("text")).alias("words"),
        )
    )
    sketch = stored(sketches(named, threshold), "sketch")
    # Stored, so that Spark knows its size and sends it round only if it is small.
    pairs = stored(
        candidates(texts, sketch).groupBy("doc_id").agg(F.collect_set("item").alias("items")),
        "pairs",
    )
    same = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id"))
    held = (
        texts.alias("t")
        .join(pairs.alias("p"), same)
        .select("t.doc_id", "items", shingle_texts("words").alias("of_doc"))
    )
    wanted = named.select("item_id", "item", shingle_texts("words").alias("of_item"))
    found = (
        held.select("doc_id", "of_doc", F.explode("items").alias("item"))
        .join(wanted, "item")
        .select(
            "doc_id",
            "item_id",
            F.size("of_item").cast("long").alias("n_shingles"),
            F.size(F.array_intersect("of_item", "of_doc")).cast("long").alias("n_found"),
        )
    )
    enough = 100 * F.col("n_found") >= round(threshold * 100) * F.col("n_shingles")
    best = found.where(enough).groupBy("doc_id", "item_id").agg(
        F.max_by(
            F.struct("n_shingles", "n_found"),
            F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles"),
        ).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.*", (F.col("b.n_found") / F.col("b.n_shingles")).alias("containment")
    )


def drop_contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    leaks = stored(contained(docs, items).select("doc_id").distinct(), "leaks")
    same = F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
    kept = docs.alias("t").join(leaks.alias("l"), same, "left_anti")
    return kept.select(*(F.col(f"t.`{c}`") for c in docs.columns))
