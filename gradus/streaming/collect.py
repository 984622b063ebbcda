"""Collecting records from problem pages as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from gradus.operators.collect import collect_outcomes
from gradus.operators.tasks import known_among, skip_collected_by_key
from gradus.sources.live import Entry, LiveFolders
from gradus.sources.pages import read_pages_of
from gradus.sources.schemas import KEYED_PROBLEM, SUBMISSION_PAGE, TASK_KEYS, TASK_PAGE

STORED = (
    StructType([*KEYED_PROBLEM.fields]).add("error", "string").add("batch_id", LongType())
)


def _stored(spark: SparkSession, target: str, entries: list[Entry]) -> DataFrame:
    """Rows of live folders, without those of batches that ran again since."""

    def rows(folders: list[str]) -> DataFrame:
        return spark.read.schema(STORED).parquet(*(f"{target}/{f}" for f in folders))

    whole = [e.folder for e in entries if not e.without]
    parts = [rows(whole)] if whole else []
    for e in entries:
        if e.without:
            parts.append(rows([e.folder]).where(~F.col("batch_id").isin(e.without)))
    if not parts:
        return spark.createDataFrame([], STORED)
    return reduce(DataFrame.unionByName, parts)


def read_collected(spark: SparkSession, target: str) -> DataFrame:
    """Records collected so far."""
    stored = _stored(spark, target, LiveFolders(spark, target).entries())
    return stored.where(F.col("error").isNull()).drop("error", "batch_id")


def read_failed(spark: SparkSession, target: str) -> DataFrame:
    """Tasks that could not be read so far, with the reason."""
    stored = _stored(spark, target, LiveFolders(spark, target).entries())
    failed = stored.where(F.col("error").isNotNull()).select(*TASK_KEYS, "error")
    return skip_collected_by_key(failed.distinct(), read_collected(spark, target))


@dataclass(frozen=True)
class PageStores:
    """List and submission pages stored by ``append_pages``. A batch reads the files
    that hold its own contests only."""

    lists: str
    submissions: str

    def of(self, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = tasks.sparkSession
        return (
            read_pages_of(spark, self.lists, tasks, TASK_PAGE),
            read_pages_of(spark, self.submissions, tasks, SUBMISSION_PAGE),
        )


def collect_stream(
    problem_pages: DataFrame,
    lookups: PageStores | Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    target: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append new records to ``target``, one commit per batch.

    Per batch: copies of a page and tasks collected earlier are dropped, the rest
    is parsed and joined with its solution. ``lookups`` are stores by contest, or a
    function that opens the list pages and submission pages anew for each batch; large
    stores need the former. A batch that runs again after a failure
    takes the place of its own rows and compares with the others only, so the
    result is the same. Folders of batches are merged in tiers (``sources.live``), so
    many batches leave few files. Failed tasks stay open: a new crawl of their page is
    tried again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live = LiveFolders(spark, target)
        earlier = _stored(spark, target, live.entries()).where(
            F.col("error").isNull() & (F.col("batch_id") != batch_id)
        )
        if isinstance(lookups, PageStores):
            list_pages, submission_pages = lookups.of(batch.select(*TASK_KEYS))
        else:
            list_pages, submission_pages = lookups(spark)
        outcomes = collect_outcomes(
            batch, list_pages, submission_pages, known_among(batch, earlier)
        )
        folder = live.fresh()
        kept = outcomes.withColumn("batch_id", F.lit(batch_id).cast("long"))
        kept.write.parquet(f"{target}/{folder}")
        live.add(folder, batch_id)

        def rewrite(entries: list[Entry], into: str) -> None:
            rows = _stored(spark, target, entries)
            # As many files as the largest of the folders has: partitions are few rows.
            rows.coalesce(max(1, rows.rdd.getNumPartitions() // len(entries))).write.parquet(
                f"{target}/{into}"
            )

        while live.merge(rewrite):
            pass

    return (
        problem_pages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
