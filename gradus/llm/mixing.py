"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Documents
are laid side by side in order of size, the expected copies are summed up, one
offset in [0, 1) is added, and a document is taken once for each whole number that
its part of the line crosses. In order of size, each size class gives its share, so
the words taken come near the target.

A source may hold most rows, so no window runs over a whole source. Its line is cut
into chunks (size class, then a hash of the id); chunk counts are summed up first
(one row per chunk), and rows are numbered inside their chunk only.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; a source without words has target 0 and gives nothing; null ids are ids
like any other; repeated rows are separate documents; an empty table gives an empty
mix. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import WORD, stored

#: No document is taken more often.
MAX_COPIES = 3
#: Parts that each size class of a source is cut into.
PARTS = 32
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size`` in words."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    return docs.select(
        F.col("doc_id"), F.col("source"), size.cast("long").alias("size")
    )


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that is fixed by its parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources weigh 1, 2, 3 in turn. With a common level L a source gets
    min(L * weight, MAX_COPIES * size); L is where these add up to all words. In
    order of cap per weight the full sources come first, so L follows from running
    sums. The windows run over one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((turn - 1) % 3 + 1).cast("double"))
    per = per.withColumn("cap", (F.lit(MAX_COPIES) * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"),
        F.sum("source_size").over(whole).cast("double").alias("words"),
        F.sum("weight").over(whole).alias("weights"),
    )
    level = (F.col("words") - F.col("full")) / (F.col("weights") - F.col("full_weight"))
    # The level of the first source that isn't full; the others stop at their cap.
    first = F.struct(F.row_number().over(by_level).alias("at"), level.alias("level"))
    per = per.withColumn(
        "fits", F.when(level * F.col("weight") <= F.col("cap"), first)
    ).withColumn("level", F.min("fits").over(whole)["level"])
    return per.select(
        "source",
        F.col("source_size").cast("long"),
        F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"),
    )


def _chunk() -> tuple[Column, Column]:
    """Place of a document on its source's line: size class, part."""
    digits = F.length(F.bin("size"))
    fine = F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")
    part = F.floor(_unit(F.lit(SEED), F.col("doc_id").cast("string")) * PARTS)
    return digits * 8 + fine, part


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every document."""
    sized = sizes(docs)
    klass, part = _chunk()
    # Slim, and read three times: texts are counted once.
    placed = stored(sized.select("*", klass.alias("klass"), part.alias("part")), "mix")
    chunk = ["source", "klass", "part"]
    counts = placed.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    line = Window.partitionBy("source").orderBy("klass", "part")
    starts = counts.select(
        *chunk,
        F.coalesce(
            F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("start"),
    )
    goals = targets(counts).withColumn(
        "offset", _unit(F.lit(SEED), F.coalesce(F.col("source"), F.lit("")))
    )
    plan = starts.alias("s").join(
        goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))
    ).select("s.*", "source_size", "target", "offset")
    numbered = placed.withColumn(
        "i", F.row_number().over(Window.partitionBy(*chunk).orderBy("size", "doc_id"))
    )
    rate = F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")
    ).otherwise(F.lit(0.0))
    at = F.col("start") + F.col("i")
    copies = F.floor(F.col("offset") + at * rate) - F.floor(
        F.col("offset") + (at - 1) * rate
    )
    same = (
        F.col("d.source").eqNullSafe(F.col("p.source"))
        & (F.col("d.klass") == F.col("p.klass"))
        & (F.col("d.part") == F.col("p.part"))
    )
    return (
        numbered.alias("d")
        .join(plan.alias("p"), same)
        .select("d.doc_id", "d.size", "p.source_size", "p.target", copies.alias("copies"))
        .select("*", (F.col("copies") * F.col("size")).alias("taken"))
    )
