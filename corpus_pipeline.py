"""From raw documents to a training mix: five stages, each written and read again.

Every stage takes all documents that the one before kept, and returns those that it
keeps with all their columns, whatever else the table holds. The last one returns
what the mix takes of each document.

Defined results: null, empty and very short texts fail the base rules of the first
stage; labels without a bad document teach no further rule; of copies the smallest id
stays; texts left without words go; an empty table of documents gives no rows, and
empty labels or benchmark items reject nothing. Whole texts pass, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import (
    decontaminate,
    jaccard_join,
    mixing,
    quality_rules,
    substring_dedup,
)
from gradus.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has."""
    return substring_dedup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contained(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("mixing to target weights", mix),
]

#: The rules are learned and the joins run over components: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
