"""Tasks: keys, URLs, submissions, and what has been collected already."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.constants import (
    CONTEST_PREFIX,
    SUBMISSION_LANGUAGE,
    SUBMISSION_STATUS,
    TASK_LETTERS,
)
from gradus.session import materialise
from gradus.sources.schemas import TASK_KEYS

# A frame is broadcast on purpose only when its row count is known when the plan
# is built and stays below this.
BROADCAST_ROWS = 100_000


def with_letters(
    contests: DataFrame, letters: Sequence[str] = TASK_LETTERS
) -> DataFrame:
    """Task keys of every contest: (contest_id, task_id, letter)."""
    return contests.select(
        "contest_id", F.explode(F.array(*map(F.lit, letters))).alias("letter")
    ).select(
        "contest_id", F.concat_ws("_", "contest_id", "letter").alias("task_id"), "letter"
    )


def task_grid(
    spark: SparkSession,
    start: int,
    end: int,
    letters: Sequence[str] = TASK_LETTERS,
    prefix: str = CONTEST_PREFIX,
) -> DataFrame:
    """Task keys of contests ``start`` to ``end``, both included. Marked for
    broadcast while it is small."""
    contests = spark.range(start, end + 1).select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("contest_id")
    )
    grid = with_letters(contests, letters)
    rows = max(0, end - start + 1) * len(letters)
    return F.broadcast(grid) if rows <= BROADCAST_ROWS else grid


# --- URLs ----------------------------------------------------------------------


def problem_url(base: str) -> Column:
    return F.concat(
        F.lit(base), F.lit("/contests/"), "contest_id", F.lit("/tasks/"), "task_id"
    )


def submission_list_url(
    base: str,
    language: str = SUBMISSION_LANGUAGE,
    status: str = SUBMISSION_STATUS,
) -> Column:
    return F.concat(
        F.lit(base),
        F.lit("/contests/"),
        "contest_id",
        F.lit("/submissions?f.Task="),
        "task_id",
        F.lit("&f.LanguageName="),
        F.url_encode(F.lit(language)),
        F.lit("&f.Status="),
        F.lit(status),
        F.lit("&f.User="),
    )


def submission_url(base: str) -> Column:
    return F.concat(
        F.lit(base),
        F.lit("/contests/"),
        "contest_id",
        F.lit("/submissions/"),
        "submission_id",
    )


# --- Submissions ---------------------------------------------------------------


def submission_filter(
    df: DataFrame,
    *,
    status: Column,
    language: Column | None = None,
    task: Column | None = None,
    want_status: str = SUBMISSION_STATUS,
    want_language: str = SUBMISSION_LANGUAGE,
    want_task: str | int | None = None,
) -> DataFrame:
    """Submissions with the wanted status, and language and task where given;
    any user. Plain comparisons, so they reach the scan."""
    df = df.where(status == want_status)
    if language is not None:
        df = df.where(language == want_language)
    if task is not None and want_task is not None:
        df = df.where(task == want_task)
    return df


def first_accepted(
    submissions: DataFrame, keys: Iterable[str], order: str, *values: str
) -> DataFrame:
    """First submission per task by ``order``, with ``values`` of that one row: of rows
    with equal ``order`` the one with the smallest values. Rows without ``order`` come
    in no place. Aggregated with map-side partials, so a hot task costs no more than
    any."""
    row = F.struct(F.col(order), *values)
    first = F.min(F.when(F.col(order).isNotNull(), row)).alias("__row")
    return submissions.groupBy(*keys).agg(first).select(
        *keys, *(F.col("__row").getField(c).alias(c) for c in (order, *values))
    )


def require_fields(df: DataFrame, *fields: str) -> DataFrame:
    """Rows in which all ``fields`` are there."""
    for field in fields:
        df = df.where(F.col(field).isNotNull())
    return df


def attach_solution(
    problems: DataFrame, solutions: DataFrame, keys: Sequence[str] = TASK_KEYS
) -> DataFrame:
    """Problems with their solution; tasks that lack either are left out.
    ``solutions`` holds one row per task (see ``first_accepted``), so a task
    that occurs often on the other side cannot multiply."""
    return require_fields(problems, *keys).join(
        require_fields(solutions, "solution"), list(keys), "inner"
    )


# --- What is there already -----------------------------------------------------


def collected_titles(
    existing: DataFrame, grid: DataFrame, prefix: str | Sequence[str] = CONTEST_PREFIX
) -> DataFrame:
    """Tasks of ``grid`` that some existing title names: it starts with
    "LETTER -" and holds the contest id in any case. ``prefix``: what the grid's
    contest ids begin with, one or several.

    "Holds" becomes equality by listing, per title, every contest id it holds:
    each number after a prefix, cut after every digit (a title with abc210 also
    holds abc21).
    """

    def ids(start: str):
        numbers = F.regexp_extract_all(
            F.lower("title"), F.lit(f"{re.escape(start.lower())}([0-9]+)"), F.lit(1)
        )
        return F.flatten(
            F.transform(
                numbers,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(n)),
                    lambda k: F.concat(F.lit(start), F.substring(n, F.lit(1), k)),
                ),
            )
        )

    starts = [prefix] if isinstance(prefix, str) else list(prefix)
    cuts = F.flatten(F.array(*map(ids, starts)))
    named = existing.where(F.col("title").contains(" -")).select(
        F.substring_index("title", " -", 1).alias("__letter"),
        F.explode(F.array_distinct(cuts)).alias("__contest"),
    )
    # Only pairs that are in the grid survive, and no more than one of each.
    return (
        named.join(
            grid.select(
                F.upper("letter").alias("__letter"), F.col("contest_id").alias("__contest")
            ),
            ["__letter", "__contest"],
            "left_semi",
        )
        .distinct()
    )


def skip_collected(
    grid: DataFrame, existing: DataFrame, prefix: str | Sequence[str] = CONTEST_PREFIX
) -> DataFrame:
    """Tasks of the grid that no existing title names, by equi-joins only."""
    hits = collected_titles(existing, grid, prefix)
    return grid.join(
        hits,
        (F.upper("letter") == F.col("__letter"))
        & (F.col("contest_id") == F.col("__contest")),
        "left_anti",
    )


def skip_collected_by_key(
    tasks: DataFrame, existing: DataFrame, keys: Sequence[str] = TASK_KEYS
) -> DataFrame:
    """Tasks whose key is not among the existing ones. Existing records may hold
    a task many times; one of each goes into the join."""
    return tasks.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def known_among(
    tasks: DataFrame, existing: DataFrame, keys: Sequence[str] = TASK_KEYS
) -> DataFrame:
    """Keys of those ``tasks`` that exist, for few tasks against very many
    existing records. The tasks are counted; if they are few enough, their keys
    are broadcast and the existing records are only scanned."""
    wanted = tasks.select(*keys).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return existing.select(*keys).join(wanted, list(keys), "left_semi").distinct()


def one_per_key(
    df: DataFrame, keys: Sequence[str], order: str | None = None, error: str | None = None
) -> DataFrame:
    """One row per key: the first by ``order``, else the smallest row, so that a
    repeated task picks the same one. Rows without ``error`` come first, so a broken
    copy never hides a good one. Copies are dropped map-side."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    rank = [F.col(error).isNotNull()] if error else []
    if order is not None:
        rank.append(F.col(order))
    row = F.min_by(rest, F.struct(*rank, rest)) if rank else F.min(rest)
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*")


def one_text_per_key(
    df: DataFrame, keys: Sequence[str], error: str = "error"
) -> DataFrame:
    """The rows of ``one_per_key(df, keys, error=error)``, chosen on slim rows: texts
    are neither sorted nor shuffled to find copies.

    ``df`` is stored once. Of each row its key, whether it has an ``error``, two
    hashes and a number are aggregated in buffers of fixed width. What these decide,
    equal copies and broken ones beside a good one, is dropped by number, which no
    hot key can skew. Only good rows of one key that differ (or broken ones, where no
    good one is) are compared by their texts. Null keys count as equal.
    """
    kept = materialise(df.withColumn("__id", F.monotonically_increasing_id()))
    rest = [c for c in df.columns if c not in keys]
    good = F.col(error).isNull()
    slim = kept.select(
        *keys,
        good.alias("__good"),
        F.xxhash64(*rest).alias("__hash"),
        F.xxhash64(F.lit(1), *rest).alias("__check"),
        "__id",
    )
    distinct = slim.groupBy(*keys, "__good", "__hash", "__check").agg(
        F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n")
    )
    per_key = distinct.groupBy(*keys).agg(
        F.sum("__n").alias("__n"),
        F.count_if("__good").alias("__n_good"),
        F.count(F.lit(1)).alias("__n_rows"),
        F.min(F.when(F.col("__good"), F.col("__id"))).alias("__good_id"),
        F.min("__id").alias("__any_id"),
    )
    if per_key.where("__n > 1").isEmpty():
        return kept.drop("__id")

    per_key = materialise(per_key)
    none_good = F.col("__n_good") == 0
    settled = F.when(none_good, F.col("__n_rows") == 1).otherwise(F.col("__n_good") == 1)
    winners = per_key.where(settled).select(
        F.coalesce("__good_id", "__any_id").alias("__id")
    )
    others = _checked(materialise(slim.select("__id").join(winners, "__id", "left_anti")))
    chosen = kept.join(others, "__id", "left_anti").drop("__id")
    open_keys = per_key.where(~settled).select(
        none_good.alias("__none_good"), *(F.col(k).alias(f"__key_{k}") for k in keys)
    )
    if open_keys.isEmpty():
        return chosen
    same_key = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    disputed = distinct.join(
        open_keys, [*same_key, F.col("__good") != F.col("__none_good")]
    ).select("__id")
    rows = kept.join(_checked(materialise(disputed)), "__id", "left_semi").drop("__id")
    return chosen.unionByName(one_per_key(rows, keys, error=error))


def parsed_per_key(
    pages: DataFrame,
    keys: Sequence[str],
    parse: Callable[[DataFrame], DataFrame],
    error: str = "error",
) -> DataFrame:
    """``one_per_key(parse(pages), keys, error=error)``; ``parse`` gives a row per page.

    Keys that pages share are found before, by a scan of the keys alone. All other
    pages, in general nearly all, pass with their texts neither stored nor compared.
    Where too many keys are shared to tell their pages apart by a broadcast,
    ``one_text_per_key`` chooses among all parsed rows.
    """
    copied = (
        pages.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(*(F.col(k).alias(f"__key_{k}") for k in keys))
    )
    if copied.isEmpty():
        return parse(pages)
    copied = materialise(copied)
    if copied.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return one_text_per_key(parse(pages), keys, error)
    copied = F.broadcast(copied)
    same_key = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    copies = parse(pages.join(copied, same_key, "left_semi"))
    return parse(pages.join(copied, same_key, "left_anti")).unionByName(
        one_text_per_key(copies, keys, error)
    )


def _checked(few: DataFrame) -> DataFrame:
    """``few`` with a broadcast hint if its rows, counted, are below the bound."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return F.broadcast(few)
    return few
