"""Collecting new problem/solution records from stored pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from gradus.operators.extract import (
    first_listed,
    listed_submissions,
    page_parts,
    problem_records,
    quarantine,
    submission_code,
)
from gradus.operators.tasks import (
    CONTEST_PREFIX,
    one_per_key,
    parsed_per_key,
    skip_collected,
    skip_collected_by_key,
)
from gradus.session import materialise
from gradus.sources.problems import read_or_empty
from gradus.sources.schemas import KEYED_PROBLEM, TASK_KEYS


Skip = Callable[[DataFrame, DataFrame], DataFrame]


def skip_pages_by_title(
    pages: DataFrame, existing: DataFrame, prefix: str | Sequence[str] = CONTEST_PREFIX
) -> DataFrame:
    """Pages whose task no existing title names; the letter ends the task id."""
    letter = F.substring_index("task_id", "_", -1)
    return skip_collected(pages.withColumn("letter", letter), existing, prefix).drop(
        "letter"
    )


def solutions_for(
    tasks: DataFrame, list_pages: DataFrame, submission_pages: DataFrame
) -> DataFrame:
    """First accepted solution of each task: (contest_id, task_id, solution,
    error). Lists are parsed for the wanted tasks only, and of the submission
    pages only those that the lists point to. Copies are parsed each in its place
    and dropped afterwards, so pages are not sorted and a readable copy wins.

    The picked submissions (keys only) are stored in between, because they are
    needed twice.
    """
    wanted = list_pages.join(tasks.select(*TASK_KEYS), TASK_KEYS, "left_semi")
    listed = first_listed(listed_submissions(wanted.select(*TASK_KEYS, "html")))
    picks = materialise(one_per_key(listed, TASK_KEYS, error="error"))
    page_keys = ["contest_id", "submission_id"]
    listed = picks.select(*page_keys).distinct()
    pages = submission_pages.select(*page_keys, "html").join(
        listed, page_keys, "left_semi"
    )
    code = parsed_per_key(pages, page_keys, submission_code)
    code = code.withColumnRenamed("error", "__code_error")
    return picks.join(code, page_keys, "left").select(
        *TASK_KEYS, "solution", F.coalesce("error", "__code_error").alias("error")
    )


def collect_outcomes(
    problem_pages: DataFrame,
    list_pages: DataFrame,
    submission_pages: DataFrame,
    existing: DataFrame,
    skip: Skip = skip_collected_by_key,
) -> DataFrame:
    """New records with an ``error`` column; rows with an error are tasks that
    failed. Known tasks are skipped before any page is parsed, by their keys or, with
    ``skip_pages_by_title``, by the titles of records without keys. Tasks without
    problem or solution give no row."""
    fresh = skip(problem_pages, existing)
    problems = parsed_per_key(
        fresh.select(*TASK_KEYS, "html"),
        TASK_KEYS,
        lambda pages: problem_records(page_parts(pages, statement_only=True)),
    ).withColumnRenamed("error", "__problem_error")
    solutions = solutions_for(
        fresh, list_pages, submission_pages
    ).withColumnRenamed("error", "__solution_error")
    both = problems.join(solutions, TASK_KEYS, "left")
    error = F.coalesce("__problem_error", "__solution_error")
    return (
        both.withColumn("error", error)
        .where(F.col("error").isNotNull() | (F.col("solution") != ""))
        .select(*(f.name for f in KEYED_PROBLEM.fields), "error")
    )


def collect_increment(
    problem_pages: DataFrame,
    list_pages: DataFrame,
    submission_pages: DataFrame,
    existing: DataFrame,
    skip: Skip = skip_collected_by_key,
) -> DataFrame:
    """New complete records only."""
    good, _ = quarantine(
        collect_outcomes(problem_pages, list_pages, submission_pages, existing, skip)
    )
    return good



_STORED = (
    StructType([*KEYED_PROBLEM.fields]).add("error", "string").add("failed", BooleanType())
)


def stored_records(spark: SparkSession, target: str) -> DataFrame:
    """Records of a dataset kept by ``collect_into``; none if it does not exist."""
    stored = read_or_empty(spark, target, _STORED).where(~F.col("failed"))
    return stored.drop("error", "failed")


def stored_failures(spark: SparkSession, target: str) -> DataFrame:
    """Dead letters of a dataset kept by ``collect_into``, one per failed try."""
    stored = read_or_empty(spark, target, _STORED).where(F.col("failed"))
    return stored.select(*TASK_KEYS, "error")


def collect_into(
    target: str,
    problem_pages: DataFrame,
    list_pages: DataFrame,
    submission_pages: DataFrame,
) -> None:
    """Add what is new to a stored dataset. Records and dead letters come from
    one computation and one write, in folders of their own."""
    existing = stored_records(problem_pages.sparkSession, target)
    outcomes = collect_outcomes(problem_pages, list_pages, submission_pages, existing)
    (
        outcomes.withColumn("failed", F.col("error").isNotNull())
        .write.partitionBy("failed")
        .mode("append")
        .parquet(target)
    )
