"""Inputs for the registered queries, derived from the given tables.

The tables hold plain prose, so completions with tags, fences and steps, and
contest pages around the prose, are built from them row by row, over the whole
table. The SQL text of each derivation runs in Spark and in the checking engine
alike (``chr(n)`` instead of escapes, no dialect functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import spread

# Thirteen variants; each exercises other branches of the rewards.
COMPLETION_SQL = """CASE doc_id % 13
WHEN 0 THEN concat('<reasoning>',chr(10),replace(text,chr(10),' '),chr(10),'</reasoning>',chr(10),'<answer>',chr(10),CAST(doc_id AS STRING),chr(10),'</answer>',chr(10))
WHEN 1 THEN concat('<reasoning>',chr(10),'Step 1. ',text,chr(10),'- edge case: algorithm > x',chr(10),'Therefore ',CAST(doc_id AS STRING),chr(10),'</reasoning>',chr(10),'<answer>',chr(10),'```cpp',chr(10),'#include <iostream>',chr(10),'using namespace std;',chr(10),'int main() { std::cout << ',CAST(doc_id AS STRING),'; }',chr(10),'```',chr(10),'</answer>')
WHEN 2 THEN concat('Sure, ',text,chr(10),'<reasoning>',text,'</reasoning> <answer>',text,'</answer>')
WHEN 3 THEN concat('<reasoning>',chr(10),text,chr(10),'</reasoning>',chr(10))
WHEN 4 THEN concat('<answer>',chr(10),text,chr(10),'</answer>',chr(10),'<reasoning>',chr(10),text,chr(10),'</reasoning>',chr(10))
WHEN 5 THEN concat('<reasoning>',chr(10),text,chr(10),'</reasoning>',chr(10),'<answer>',chr(10),'```cpp```cpp',chr(10),'int x;',chr(10),'``````',chr(10),'</answer>',chr(10),'<answer>b</answer>')
WHEN 6 THEN concat('<reasoning>',chr(10),text,chr(10),'</reasoning>',chr(10),'<answer>',chr(10),'```cpp',chr(10),'```',chr(10),'int x;',chr(10),' ```cpp ',chr(10),'```',chr(10),'</answer>')
WHEN 7 THEN text
WHEN 8 THEN concat('<reasoning>',chr(10),text,chr(10),'</reasoning>',chr(10),'<answer>',chr(10),text,chr(10),'</answer>',chr(10),'bye')
WHEN 9 THEN concat('<reasoning>',chr(10),'I think maybe perhaps clearly obviously. Time complexity; algorithm selection; data structure; edge case. Problem analysis, key observations. Thinking about it, wait, thus 7',chr(10),repeat('consider my oh ',CAST(doc_id % 9 AS INT)),text,chr(10),'</reasoning>',chr(10),'<answer>',chr(10),'7 8',chr(10),'</answer>')
WHEN 10 THEN concat(chr(9),chr(10),'<reasoning>',chr(13),text,'</reasoning>',chr(10),chr(10),'<answer>',text,'</answer>  ')
WHEN 11 THEN concat('<reasoning>',replace(text,chr(10),' '),'</reasoning> <answer>',CAST(doc_id AS STRING),'</answer> done')
ELSE concat('<reasoning>',chr(10),'short',chr(10),'</reasoning>',chr(10),'<answer>',chr(10),'x',chr(10),'</answer>') END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped_completions(docs: DataFrame) -> DataFrame:
    """Completion rows from document rows; batch and streaming frames alike.
    Two completions share a prompt."""
    return docs.select(
        "doc_id",
        "lang",
        (F.col("doc_id") - F.col("doc_id") % 2).alias("prompt_id"),
        (F.col("doc_id") % 2).alias("gen_id"),
        F.array(
            F.struct(F.lit("user").alias("role"), F.col("source").alias("content"))
        ).alias("prompt"),
        F.array(
            F.struct(
                F.lit("assistant").alias("role"),
                F.expr(COMPLETION_SQL).alias("content"),
            )
        ).alias("completion"),
        F.col("doc_id").cast("string").alias("answer"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, prompt_id, gen_id, prompt, completion, answer)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return shaped_completions(spread(docs, "doc_id"))


# --- Contest pages -------------------------------------------------------------

CONTEST_SQL = "concat('abc', CAST((doc_id - doc_id % 4) / 4 AS BIGINT))"
LETTER_SQL = "substr('abcd', CAST(doc_id % 4 AS INT) + 1, 1)"
TASK_SQL = f"concat({CONTEST_SQL}, '_', {LETTER_SQL})"
TITLE_SQL = (
    f"concat(upper({LETTER_SQL}), ' - Task of A', upper(substr({CONTEST_SQL}, 2)),"
    " ' ', lang)"
)
_ESCAPED = "replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;')"


def _part(header: str, body: str) -> str:
    return (
        f"'<div class=\"part\"><section><h3>{header}</h3>',{body},'</section></div>',"
        "chr(10)"
    )


_STATEMENT = _part(
    "Problem Statement",
    f"'<p> ',{_ESCAPED},' </p><p></p><p>Copy &quot;',source,'&quot; &amp; go</p>'",
)
_CONSTRAINTS = _part("Constraints", "'<div> 1 &lt; N &lt; ',CAST(doc_id AS STRING),'</div>'")
_INPUT = _part("Input Format", "'<div><b>N</b> lines</div>'")
_OUTPUT = _part("Output Format", "'<div>One line</div>'")
_IN1 = _part("Sample Input 1", "'<div><pre>',CAST(doc_id AS STRING),chr(10),'</pre></div>'")
_OUT1 = _part("Sample Output 1", "'<div><pre>',CAST(n_chars AS STRING),'</pre></div>'")
_IN2 = _part("Sample Input 2", "'<div><pre> 2 3</pre></div>'")
_OUT2 = _part("Sample Output 2", "'<div><pre>5 </pre></div>'")


def _page(*parts: str, title: bool = True, lang: str = "lang-en", box: str = "task-statement"):
    heading = f"'<span class=\"h2 top\"> ',{TITLE_SQL},chr(10),'</span>'," if title else ""
    return (
        f"concat('<html><body>',{heading}'<div id=\"{box}\">"
        f"<span class=\"lang-ja\">x</span><span class=\"{lang}\">',"
        + ",".join(parts)
        + ",'</span></div></body></html>')"
    )


# Thirteen page variants; each exercises another branch of the extraction.
PROBLEM_PAGE_SQL = "CASE doc_id % 13 " + " ".join(
    f"WHEN {i} THEN {page}"
    for i, page in enumerate(
        [
            _page(_STATEMENT, _CONSTRAINTS, _INPUT, _OUTPUT, _IN1, _OUT1, _IN2, _OUT2),
            _page(_STATEMENT, box="other"),
            _page(_STATEMENT, lang="lang-fr"),
            _page(_STATEMENT, title=False),
            _page(
                _STATEMENT,
                "'<div class=\"part\">no section</div>'",
                "'<div class=\"part\"><section><p>no header</p></section></div>'",
                _OUTPUT,
            ),
            _page(_STATEMENT, _part("Sample Input 1", "'<pre>1</pre>'"), _OUT1, _IN2, _OUT2),
            _page(
                _STATEMENT,
                _part("Input", "'<div>not a format</div>'"),
                _part("Input/Output Format", "'<div>both</div>'"),
            ),
            _page(_CONSTRAINTS, _STATEMENT, _part("CONSTRAINTS", "'<div>last</div>'"), _IN1, _OUT1),
            _page(_STATEMENT, _IN1, _CONSTRAINTS, _IN2),
            _page(_STATEMENT, _IN1, "'<div class=\"part\"><section><pre>1</pre></section></div>'"),
            _page(_STATEMENT, _IN1, "'<div class=\"part\"><h3>Sample Output 1</h3></div>'"),
            _page(_STATEMENT, _IN1, "'<hr>text between'", _OUT1, _IN2, _part("Sample Output 2", "'<div>no pre</div>'")),
            _page(_part("Problem Statement", "'<div>no paragraph</div>'"), _IN1, _OUT1),
        ]
    )
) + " END"

# Submission lists: nothing but a header; links after an unlinked row; an empty
# target first; a row without cells; a target that ends in a slash; plain lists.
_ROW_HEAD = "'<table><tr><th>id</th><th>x</th></tr>'"
_ROWS = ",".join(
    f"'<tr><td>AC</td><td><a href=\"/contests/',{CONTEST_SQL},'/submissions/',"
    f"CAST(doc_id * 10 + {k} AS STRING),'\">Detail</a></td></tr>'"
    for k in (1, 2, 3)
)
LIST_PAGE_SQL = (
    "CASE doc_id % 7 "
    f"WHEN 0 THEN concat({_ROW_HEAD},'</table>') "
    f"WHEN 1 THEN concat({_ROW_HEAD},'<tr><td>WJ</td><td>none</td></tr>',{_ROWS},'</table>') "
    f"WHEN 2 THEN concat({_ROW_HEAD},'<tr><td><a href=\"/z/9\">z</a></td><td><a href=\"\">e</a></td></tr>',{_ROWS},'</table>') "
    f"WHEN 3 THEN concat({_ROW_HEAD},'<tr>bare</tr>',{_ROWS},'</table>') "
    f"WHEN 4 THEN concat({_ROW_HEAD},'<tr><td><a href=\"/s/\">s</a></td></tr>',{_ROWS},'</table>') "
    f"ELSE concat({_ROW_HEAD},{_ROWS},'</table>') END"
)
SUBMISSION_PAGE_SQL = (
    "CASE doc_id % 5 WHEN 1 THEN '<pre>other</pre>' ELSE "
    "concat('<pre id=\"submission-code\">#include &lt;iostream&gt;',chr(10),"
    f"{_ESCAPED},chr(10),'// ',CAST(nth AS STRING),'</pre>') END"
)


def _keyed(docs: DataFrame, sql: str) -> DataFrame:
    return docs.select(
        "doc_id",
        F.expr(CONTEST_SQL).alias("contest_id"),
        F.expr(TASK_SQL).alias("task_id"),
        F.expr(sql).alias("html"),
    )


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def keyed_pages(docs: DataFrame) -> DataFrame:
    """Problem pages from document rows; batch and streaming frames alike."""
    return _keyed(docs, PROBLEM_PAGE_SQL)


def problem_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_pages(_docs(spark, sf_dir, "text", "lang", "source", "n_chars"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_docs(spark, sf_dir), LIST_PAGE_SQL)


def submission_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the first two listed submissions of every task."""
    docs = _docs(spark, sf_dir, "text").withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(2))))
    return docs.select(
        "doc_id",
        F.expr(CONTEST_SQL).alias("contest_id"),
        (F.col("doc_id") * 10 + F.col("nth")).cast("string").alias("submission_id"),
        F.expr(SUBMISSION_PAGE_SQL).alias("html"),
    )


def existing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth task counts as collected; every tenth occurs twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 5 = 0")
    keys = docs.select(
        "doc_id", F.expr(CONTEST_SQL).alias("contest_id"), F.expr(TASK_SQL).alias("task_id")
    )
    return keys.unionByName(keys.where("doc_id % 10 = 0"))


def all_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task of every document."""
    return table(spark, sf_dir, "documents").select(
        F.expr(CONTEST_SQL).alias("contest_id"), F.expr(TASK_SQL).alias("task_id")
    )


def titled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing records known by title only: every third task."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    return docs.select(F.expr(TITLE_SQL).alias("title"))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .select(F.expr(CONTEST_SQL).alias("contest_id"))
        .distinct()
    )


# --- Conversations as problems and solutions -----------------------------------


def first_turns(spark: SparkSession, sf_dir: str, role: str, name: str) -> DataFrame:
    """First turn of a role per conversation, as column ``name``."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias(name))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem = first user turn, solution = first assistant turn, where there
    are both. One pass: a turn of another role has no order and never wins."""

    def first(role: str, name: str):
        own = F.col("role") == role
        return F.min_by("text", F.when(own, F.col("turn"))).alias(name)

    turns = table(spark, sf_dir, "conversations")
    return (
        turns.where(F.col("role").isin("user", "assistant"))
        .groupBy("conv_id")
        .agg(first("user", "description"), first("assistant", "solution"))
        .where("description IS NOT NULL AND solution IS NOT NULL")
    )
