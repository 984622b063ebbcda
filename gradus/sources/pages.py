"""Stored pages, laid out by contest, of which a batch reads the files it needs.

A commit sorts its pages by contest into files of about ``FILE_BYTES``, however many
that makes, so a file holds a range of contests. ``_ranges`` under the path has one row
for each file: its first and last contest. A lookup reads only the files whose range
holds one of its contests.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradus.sources.live import Entry, LiveFolders

FILE_BYTES = 256 << 20
#: Contests of a batch that are compared with the ranges; a batch with more reads all.
MOST_CONTESTS = 100_000
RANGES = "folder string, file string, low string, high string, pages bigint"


def _write_sorted(df: DataFrame, path: str, file_bytes: int) -> None:
    n_bytes = df.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n_files = max(1, -(-n_bytes // file_bytes))
    ranged = df.repartitionByRange(n_files, "contest_id").sortWithinPartitions("contest_id")
    ranged.write.parquet(path)


def _write_ranges(spark: SparkSession, path: str, folder: str) -> None:
    files = spark.read.parquet(f"{path}/{folder}").groupBy(
        F.input_file_name().alias("file")
    )
    ranges = files.agg(
        F.min("contest_id").alias("low"),
        F.max("contest_id").alias("high"),
        F.count(F.lit(1)).alias("pages"),
    )
    named = ranges.select(F.lit(folder).alias("folder"), "file", "low", "high", "pages")
    named.coalesce(1).write.parquet(f"{path}/_ranges/{folder}")


def append_pages(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Add pages (``contest_id``, ``html`` and other columns) to a store; small commits
    are merged in tiers. Pages without a contest are found by no lookup and left out."""
    spark, live = df.sparkSession, LiveFolders(df.sparkSession, path)

    def put(pages: DataFrame, folder: str) -> None:
        _write_sorted(pages, f"{path}/{folder}", file_bytes)
        _write_ranges(spark, path, folder)

    folder = live.fresh()
    put(df.where(F.col("contest_id").isNotNull()), folder)
    live.add(folder, live.next_commit())

    def rewrite(entries: list[Entry], into: str) -> None:
        put(spark.read.parquet(*(f"{path}/{e.folder}" for e in entries)), into)

    while live.merge(rewrite):
        pass


def _files_of(spark: SparkSession, path: str, contests: list[str]) -> list[str]:
    """Files of the live folders whose range holds one of the contests. Like Spark's own
    list of files this is kept on the driver."""
    folders = [f"{path}/_ranges/{e.folder}" for e in LiveFolders(spark, path).entries()]
    if not folders or not contests:
        return []
    ordered, found = sorted(contests), []
    for r in spark.read.schema(RANGES).parquet(*folders).toLocalIterator():
        at = bisect_left(ordered, r["low"])
        if at < len(ordered) and ordered[at] <= r["high"]:
            found.append(r["file"])
    return found


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All pages of a store; none if it does not exist."""
    folders = [f"{path}/{e.folder}" for e in LiveFolders(spark, path).entries()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_pages_of(
    spark: SparkSession, path: str, tasks: DataFrame, schema: StructType
) -> DataFrame:
    """Stored pages of the contests of ``tasks``, and of those that share a file with
    one. Contests are counted first: more than ``MOST_CONTESTS`` are not collected, and
    the whole store is read."""
    wanted = tasks.select("contest_id").where(F.col("contest_id").isNotNull()).distinct()
    contests = [r[0] for r in wanted.limit(MOST_CONTESTS + 1).collect()]
    if len(contests) > MOST_CONTESTS:
        return read_store(spark, path, schema)
    files = _files_of(spark, path, contests)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)
