"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each runs one operator over whole tables (or rows Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import html as H
from gradus.functions import text as T
from gradus.functions.registry import (
    batch_reward,
    register_reward,
    split_errors,
    unregister_reward,
)
from gradus.functions.registry import (
    caught_reward as caught,
)
from gradus.functions.rewards import ACTIVE, ALL
from gradus.operators import extract as X
from gradus.operators import prompts as P
from gradus.operators import tasks as J
from gradus.operators.collect import (
    collect_increment,
    collect_outcomes,
    skip_pages_by_title,
)
from gradus.operators.scoring import (
    group_advantage,
    reward_summary,
    score,
    total_reward,
)
from gradus.operators.scoring import (
    best_of_group as best_group,
)
from gradus.plans import derived as D
from gradus.session import materialise, shared_path, spread
from gradus.sources.pages import append_pages
from gradus.sources.problems import (
    append_records,
    dataset_count,
    read_pages,
    read_problems,
    write_problems,
)
from gradus.sources.problems import (
    malformed_records as bad_records,
)
from gradus.sources.schemas import KEYED_PROBLEM
from gradus.streaming.collect import PageStores, collect_stream, read_collected
from gradus.streaming.score import score_stream

Query = Callable[[SparkSession, str], DataFrame]

BASE_URL = "https://contest.example"
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion texts as column ``c``."""
    return D.completions(spark, sf_dir).select(
        "doc_id", P.completion_text().alias("c")
    )


def _flat_samples(samples: str = "sample_tests"):
    return F.array_join(
        F.transform(
            samples, lambda s: F.concat(s["input"], F.lit(" => "), s["output"])
        ),
        " | ",
    )


# --- Sources, keys and URLs ----------------------------------------------------


@query
def page_scan(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("html_length"))


@query
def json_round_trip(spark, sf_dir):
    """Records written as JSON Lines to the shared folder and read back."""
    path = shared_path(spark, "problems")
    records = D.dialogues(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("title"),
        "description",
        F.array(
            F.struct(
                F.lit("in").alias("input"),
                F.length("solution").cast("string").alias("output"),
            )
        ).alias("sample_tests"),
        "solution",
    )
    write_problems(records, path, fmt="jsonl")
    back = read_problems(spark, path, fmt="jsonl", tolerant=False)
    return back.select(
        "title",
        "description",
        _flat_samples().alias("samples"),
        "solution",
        F.col("constraints").isNull().alias("no_constraints"),
    )


def _array_files(spark, sf_dir) -> str:
    """Dialogues as files of one JSON array each, twenty numbers a file; every fourth
    file ends too early."""
    path = shared_path(spark, "arrays")
    records = D.dialogues(spark, sf_dir).withColumn("file", F.floor(F.col("conv_id") / 20))
    record = F.struct(F.col("conv_id").cast("string").alias("title"), "description", "solution")
    arrays = records.groupBy("file").agg(
        F.array_join(F.collect_list(F.to_json(record)), ",\n").alias("held")
    )
    whole = F.concat(F.lit("["), "held", F.lit("]"))
    cut = F.concat(F.lit("["), F.left("held", F.length("held") - 9))
    made = arrays.select("file", F.when(F.col("file") % 4 == 1, cut).otherwise(whole).alias("value"))
    # One row, so one file, in each folder.
    made.write.partitionBy("file").text(path)
    return path


@query
def json_array_read(spark, sf_dir):
    """A tolerant read: files that end too early are left out, each as a whole."""
    back = read_problems(spark, f"{_array_files(spark, sf_dir)}/file=*", fmt="json")
    return back.select("title", "description", "solution", F.col("sample_tests").isNull().alias("no_samples"))


def _indented_arrays(spark, sf_dir) -> str:
    """Dialogues as array files whose records are indented by two spaces, 200 numbers a
    file; every fourth file lacks its end."""
    path = shared_path(spark, "indented")
    records = D.dialogues(spark, sf_dir).withColumn("file", F.floor(F.col("conv_id") / 200))
    record = F.struct(F.col("conv_id").cast("string").alias("title"), "description", "solution")
    lines = F.replace(F.to_json(record, {"pretty": "true"}), F.lit("\n"), F.lit("\n  "))
    arrays = records.groupBy("file").agg(
        F.array_join(F.collect_list(lines), ",\n  ").alias("held")
    )
    end = F.when(F.col("file") % 4 == 1, "").otherwise("\n]")
    made = arrays.select("file", F.concat(F.lit("[\n  "), "held", end).alias("value"))
    made.write.partitionBy("file").text(path)
    return path


@query
def json_array_split(spark, sf_dir):
    """The same read of array files that many tasks share, each file by its records."""
    back = read_problems(
        spark, f"{_indented_arrays(spark, sf_dir)}/file=*", fmt="json", indent=2
    )
    return back.select("title", "description", "solution", F.col("sample_tests").isNull().alias("no_samples"))


@query
def malformed_records(spark, sf_dir):
    """The dead letters of both forms: lines that are no record, files cut short."""
    path = shared_path(spark, "lines")
    text = F.format_string('{"title": "%d", "solution": "x"', "conv_id")
    closed = F.when(F.col("conv_id") % 3 == 0, text).otherwise(F.concat(text, F.lit("}")))
    D.dialogues(spark, sf_dir).select(closed).write.text(path)
    lines = bad_records(spark, path).select(F.lit("line").alias("kind"), "record")
    files = bad_records(spark, f"{_array_files(spark, sf_dir)}/file=*", fmt="json")
    number = F.regexp_extract("file", "file=([0-9]+)", 1)
    return lines.unionByName(files.select(F.lit("file").alias("kind"), number.alias("record")))


@query
def task_grid(spark, sf_dir):
    return J.with_letters(D.contests(spark, sf_dir))


@query
def page_url(spark, sf_dir):
    keys = J.with_letters(D.contests(spark, sf_dir)).withColumn(
        "submission_id", F.length("task_id").cast("string")
    )
    return keys.select(
        "task_id",
        J.problem_url(BASE_URL).alias("problem_url"),
        J.submission_list_url(BASE_URL).alias("list_url"),
        J.submission_url(BASE_URL).alias("submission_url"),
    )


# --- Light extraction on the pages table ---------------------------------------


def _pages(spark, sf_dir, *columns):
    pages = D.table(spark, sf_dir, "pages").select("page_id", "html")
    return spread(pages, "page_id").select("page_id", *columns)


@query
def page_title(spark, sf_dir):
    return _pages(
        spark,
        sf_dir,
        H.page_title(F.col("html")).alias("title"),
        H.page_title(F.col("html"), "h1").alias("heading"),
    )


@query
def language_filter(spark, sf_dir):
    pages = _pages(spark, sf_dir, H.page_language(F.col("html")).alias("lang"))
    return pages.where(F.col("lang") == "en")


@query
def description(spark, sf_dir):
    joined = F.array_join(H.paragraphs(F.col("html")), "\n")
    return _pages(spark, sf_dir, joined.alias("description"))


@query
def page_links(spark, sf_dir):
    links = _pages(spark, sf_dir, F.posexplode_outer(H.link_targets(F.col("html"))))
    return links.where(F.col("pos").isNotNull()).select(
        "page_id",
        F.col("pos").alias("row_idx"),
        F.col("col").alias("href"),
        F.substring_index("col", "/", -1).alias("last_segment"),
    )


# --- Parsed contest pages ------------------------------------------------------


@query
def page_parts(spark, sf_dir):
    parsed = X.page_parts(D.problem_pages(spark, sf_dir))
    return X.part_rows(parsed, "doc_id").select(
        "doc_id",
        "part_idx",
        "has_section",
        "header",
        "part_header",
        F.array_join(F.transform("paragraphs", T.strip), "\n").alias("paragraphs"),
        "content",
        "sample",
    )


@query
def classify_section(spark, sf_dir):
    parsed = X.page_parts(D.problem_pages(spark, sf_dir))
    rows = X.part_rows(parsed, "doc_id")
    return rows.where(F.col("section_class").isNotNull()).select(
        "doc_id", "part_idx", "section_class"
    )


@query
def pair_samples(spark, sf_dir):
    parsed = X.page_parts(D.problem_pages(spark, sf_dir))
    paired = parsed.select("doc_id", X.sample_candidates().alias("s")).select(
        "doc_id", F.posexplode_outer(X.pair_samples(F.col("s")))
    )
    return paired.where(F.col("pos").isNotNull()).select("doc_id", F.col("pos").alias("nth"), "col.input", "col.output")


def _records(spark, sf_dir):
    return X.problem_records(
        X.page_parts(D.problem_pages(spark, sf_dir), statement_only=True)
    )


@query
def problem_record(spark, sf_dir):
    good, _ = X.quarantine(_records(spark, sf_dir))
    return good.withColumn("sample_tests", _flat_samples()).withColumnRenamed(
        "sample_tests", "samples"
    )


@query
def quarantine(spark, sf_dir):
    _, dead = X.quarantine(_records(spark, sf_dir))
    return dead.select("contest_id", "task_id", "error")


@query
def submission_rows(spark, sf_dir):
    return X.submission_rows(
        X.listed_submissions(D.list_pages(spark, sf_dir)), "doc_id"
    )


@query
def first_listed(spark, sf_dir):
    return X.first_listed(X.listed_submissions(D.list_pages(spark, sf_dir))).select(
        "doc_id", "submission_id", "error"
    )


@query
def submission_code(spark, sf_dir):
    return X.submission_code(D.submission_pages(spark, sf_dir)).select(
        "submission_id", "solution"
    )


# --- Submissions, joins and dataset upkeep -------------------------------------


def _feed(spark, sf_dir):
    """Events as a submission feed: type = status, user = task."""
    return D.table(spark, sf_dir, "events")


@query
def submission_filter(spark, sf_dir):
    kept = J.submission_filter(
        _feed(spark, sf_dir),
        status=F.col("event_type"),
        want_status="purchase",
        language=F.get_json_object("props", "$.k"),
        want_language="7",
    )
    return kept.select("event_id", "user_id", "value")


@query
def first_accepted(spark, sf_dir):
    accepted = J.submission_filter(
        _feed(spark, sf_dir), status=F.col("event_type"), want_status="purchase"
    )
    return J.first_accepted(accepted, ["user_id"], "event_id", "value", "ts")


@query
def require_fields(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    conversations = turns.select("conv_id").distinct()
    solutions = turns.where("role = 'assistant'")
    both = conversations.join(
        solutions.groupBy("conv_id").agg(F.min_by("text", "turn").alias("solution")),
        "conv_id",
        "left",
    )
    return J.require_fields(both, "solution")


@query
def attach_solution(spark, sf_dir):
    problems = D.first_turns(spark, sf_dir, "user", "description")
    solutions = D.first_turns(spark, sf_dir, "assistant", "solution")
    return J.attach_solution(problems, solutions, ["conv_id"])


@query
def skip_collected(spark, sf_dir):
    grid = J.with_letters(D.contests(spark, sf_dir))
    return J.skip_collected(grid, D.titled_records(spark, sf_dir))


@query
def skip_collected_by_key(spark, sf_dir):
    grid = J.with_letters(D.contests(spark, sf_dir))
    return J.skip_collected_by_key(grid, D.existing_tasks(spark, sf_dir))


@query
def contest_range(spark, sf_dir):
    """The grid between the tables' first and last contest."""
    number = F.regexp_extract("contest_id", "([0-9]+)", 1).cast("long")
    bounds = D.contests(spark, sf_dir).agg(F.min(number), F.max(number)).first()
    return J.task_grid(spark, *bounds)


@query
def append_existing(spark, sf_dir):
    old = D.all_tasks(spark, sf_dir)
    new = J.with_letters(D.contests(spark, sf_dir)).select("contest_id", "task_id")
    return append_records(old, new)


@query
def dataset_count_by(spark, sf_dir):
    return dataset_count(D.all_tasks(spark, sf_dir), "contest_id")


# --- Prompts -------------------------------------------------------------------


@query
def build_prompt(spark, sf_dir):
    built = P.build_prompt(D.dialogues(spark, sf_dir))
    first, second = F.col("prompt")[0], F.col("prompt")[1]
    return built.select(
        "conv_id",
        first["role"].alias("system_role"),
        first["content"].alias("system_content"),
        second["role"].alias("user_role"),
        second["content"].alias("user_content"),
        "answer",
    )


@query
def completion_text(spark, sf_dir):
    return _texts(spark, sf_dir)


@query
def last_user_content(spark, sf_dir):
    built = P.build_prompt(D.dialogues(spark, sf_dir))
    return built.select("conv_id", P.last_content().alias("content"))


@query
def render_chat(spark, sf_dir):
    built = P.build_prompt(D.dialogues(spark, sf_dir))
    chat = P.render_chat(
        F.col("prompt"),
        before_role="<|",
        after_role="|>\n",
        after_content="<|end|>\n",
        generation_prompt="<|assistant|>\n",
    )
    return built.select("conv_id", chat.alias("chat"))


@query
def length_budget(spark, sf_dir):
    return P.length_budget(D.completions(spark, sf_dir)).select(
        "doc_id", "prompt_words", "completion_words", "prompt_over", "completion_over"
    )


# --- Text primitives -----------------------------------------------------------


@query
def tag_block(spark, sf_dir):
    c = F.col("c")
    return _texts(spark, sf_dir).select(
        "doc_id",
        T.block(c, "reasoning").alias("reasoning"),
        T.block(c, "answer").alias("answer"),
    )


@query
def extract_answer(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", T.extract_answer(F.col("c")).alias("extracted")
    )


@query
def strip_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.strip(F.col("c")).alias("stripped"))


@query
def count_of(spark, sf_dir):
    c = F.col("c")
    return _texts(spark, sf_dir).select(
        "doc_id",
        T.count_of(c, "\n").alias("newlines"),
        T.count_of(c, "<answer>").alias("answer_tags"),
        T.count_of(c, "ee").alias("ee"),
    )


@query
def find_position(spark, sf_dir):
    c = F.col("c")
    return _texts(spark, sf_dir).select(
        "doc_id",
        T.find(c, "<reasoning>").alias("reasoning_at"),
        T.find(c, "</answer>").alias("close_at"),
    )


@query
def lower_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.lower(F.col("c")).alias("lowered"))


@query
def number_tokens(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", F.array_join(T.numbers(F.col("c")), ",").alias("numbers")
    )


@query
def number_overlap(spark, sf_dir):
    c = F.col("c")
    shared = F.array_intersect(
        T.numbers(T.block(c, "answer")), T.numbers(T.block(c, "reasoning"))
    )
    return _texts(spark, sf_dir).select("doc_id", F.size(shared).alias("shared"))


@query
def split_lines(spark, sf_dir):
    lines = T.split_lines(F.col("c"))
    return _texts(spark, sf_dir).select(
        "doc_id",
        F.size(lines).alias("n_lines"),
        F.array_join(lines, "~").alias("joined"),
    )


@query
def nonempty_lines(spark, sf_dir):
    lines = T.nonempty_lines(F.col("c"))
    return _texts(spark, sf_dir).select(
        "doc_id",
        F.size(lines).alias("n_lines"),
        F.array_join(lines, "~").alias("joined"),
    )


# --- Rewards: one query each, then together ------------------------------------


def _reward_query(name: str) -> Query:
    def run(spark, sf_dir):
        return score(D.completions(spark, sf_dir), [name]).select("doc_id", name)

    return run


for _name in ALL:
    QUERIES[_name] = _reward_query(_name)


@query
def score_all(spark, sf_dir):
    return score(D.completions(spark, sf_dir), ALL).select("doc_id", *ALL)


def _scored(spark, sf_dir):
    return total_reward(score(D.completions(spark, sf_dir)))


@query
def score_active(spark, sf_dir):
    """The training score: nine rewards and their sum."""
    return _scored(spark, sf_dir).select("prompt_id", "gen_id", *ACTIVE, "total")


@query
def weighted_total(spark, sf_dir):
    weights = {"correctness": 2.0, "introspection": 0.5}
    scored = score(D.completions(spark, sf_dir), list(weights))
    return total_reward(scored, list(weights), weights=weights).select("doc_id", "total")


@query
def group_advantages(spark, sf_dir):
    slim = materialise(_scored(spark, sf_dir).select("prompt_id", "gen_id", "total"))
    return group_advantage(slim).withColumn("advantage", F.round("advantage", 6))


def _rounded(summary: DataFrame, *keys: str) -> DataFrame:
    return summary.select(
        *keys,
        "reward",
        "n",
        *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "share_nonzero")),
    )


@query
def reward_summary_by_language(spark, sf_dir):
    scored = score(D.completions(spark, sf_dir), ALL)
    return _rounded(reward_summary(scored, ALL, by=["lang"]), "lang")


@query
def reward_summary_by_quality(spark, sf_dir):
    """Slices from another table: only keys and rewards meet the join. Completions
    without a label are a slice of their own."""
    names = [*ACTIVE, "total"]
    slim = _scored(spark, sf_dir).select("doc_id", *names)
    labels = D.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _rounded(
        reward_summary(slim.join(labels, "doc_id", "left"), names, by=["quality"]), "quality"
    )


@query
def registered_reward(spark, sf_dir):
    """A user rule as a Column expression, next to a built-in one."""
    register_reward(
        "brevity", lambda v: F.lit(1.0) / (1 + F.length(v.extracted_answer)),
        needs=["extracted_answer"],
    )
    names = ["brevity", "correctness"]
    scored = score(D.completions(spark, sf_dir), names).select("doc_id", *names)
    unregister_reward("brevity")
    return scored


@query
def best_of_group(spark, sf_dir):
    slim = _scored(spark, sf_dir).select("prompt_id", "gen_id", "total")
    return best_group(slim)


@query
def python_reward(spark, sf_dir):
    """A user rule in Python over Arrow batches."""

    def longer_than_prompt(prompts, completions, answer, lang, **kwargs):
        return [
            len(c[0]["content"]) - len(p[-1]["content"]) + (0.5 if tag == "en" else 0.0)
            for p, c, tag in zip(prompts, completions, lang)
        ]

    value = batch_reward(
        longer_than_prompt,
        F.col("prompt"),
        F.col("completion"),
        F.col("answer"),
        lang=F.col("lang"),
    )
    return D.completions(spark, sf_dir).select("doc_id", value.alias("value"))


@query
def caught_reward(spark, sf_dir):
    """A user rule that raises on some rows: they are dead letters, all others score."""

    def strict(prompts, completions, answer, **kwargs):
        if any(int(a) % 50 == 7 for a in answer):
            raise ValueError("not this one")
        return [len(c[0]["content"]) for c in completions]

    value = caught(strict, F.col("prompt"), F.col("completion"), F.col("answer"))
    scored = D.completions(spark, sf_dir).where("completion[0].content IS NOT NULL").select("doc_id", value.alias("value"))
    return split_errors(scored, "value")


# --- Incremental collection and streams ----------------------------------------


def _tables(spark, sf_dir):
    return D.list_pages(spark, sf_dir), D.submission_pages(spark, sf_dir)


def _flat(records: DataFrame) -> DataFrame:
    return records.select(
        *(f.name for f in KEYED_PROBLEM.fields if f.name != "sample_tests"),
        _flat_samples().alias("samples"),
    )


@query
def collect_new(spark, sf_dir):
    return _flat(
        collect_increment(
            D.problem_pages(spark, sf_dir),
            *_tables(spark, sf_dir),
            D.existing_tasks(spark, sf_dir),
        )
    )


@query
def collect_new_by_title(spark, sf_dir):
    return _flat(
        collect_increment(
            D.problem_pages(spark, sf_dir),
            *_tables(spark, sf_dir),
            D.titled_records(spark, sf_dir),
            skip_pages_by_title,
        )
    )


@query
def collect_failures(spark, sf_dir):
    outcomes = collect_outcomes(
        D.problem_pages(spark, sf_dir),
        *_tables(spark, sf_dir),
        D.existing_tasks(spark, sf_dir),
    )
    _, dead = X.quarantine(outcomes)
    return dead.select("contest_id", "task_id", "error")


def _stream(spark, sf_dir, name):
    """A table's files as a stream. The table is one file or a folder of files: a stream
    takes either where the path is a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


@query
def scored_stream(spark, sf_dir):
    target = shared_path(spark, "scores")
    documents = _stream(spark, sf_dir, "documents")
    # Like ``spread``, which cannot ask a stream: a table of many splits is not shuffled.
    cores = spark.sparkContext.defaultParallelism
    if D.table(spark, sf_dir, "documents").rdd.getNumPartitions() < cores:
        documents = documents.repartition(3 * cores, "doc_id")
    score_stream(
        D.shaped_completions(documents), target, shared_path(spark, "score-offsets")
    ).awaitTermination()
    return spark.read.parquet(target).select("prompt_id", "gen_id", *ACTIVE, "total")


@query
def collected_stream(spark, sf_dir):
    target = shared_path(spark, "records")
    documents = _stream(spark, sf_dir, "documents")
    lists, codes = _tables(spark, sf_dir)
    stores = PageStores(shared_path(spark, "lists"), shared_path(spark, "submissions"))
    append_pages(lists, stores.lists)
    append_pages(codes, stores.submissions)
    collect_stream(
        D.keyed_pages(documents),
        stores,
        target,
        shared_path(spark, "record-offsets"),
    ).awaitTermination()
    return _flat(read_collected(spark, target))

