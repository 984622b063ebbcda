"""Prompts, completions and their messages (arrays of role/content structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.functions.constants import (
    COMPLETION_WORD_CAP,
    PROMPT_WORD_CAP,
    SYSTEM_PROMPT,
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompt(
    df: DataFrame,
    system: str = SYSTEM_PROMPT,
    *,
    description: str = "description",
    solution: str = "solution",
) -> DataFrame:
    """Add ``prompt`` (system message, then the problem as user message) and
    ``answer`` (the solution). All other columns are kept."""
    return df.withColumns(
        {
            "prompt": F.array(
                message("system", F.lit(system)),
                message("user", F.col(description)),
            ),
            "answer": F.col(solution),
        }
    )


def completion_text(completion: str = "completion") -> Column:
    """Text of the first message; null for an empty array."""
    return F.get(F.col(completion), F.lit(0))["content"]


def last_content(prompt: str = "prompt") -> Column:
    """Text of the last message; null for an empty array."""
    return F.get(F.reverse(F.col(prompt)), F.lit(0))["content"]


def render_chat(
    messages: Column,
    *,
    before_role: str,
    after_role: str,
    after_content: str,
    generation_prompt: str = "",
) -> Column:
    """Messages as one prompt string. A model's template is the caller's: give
    the texts around role and content, and the opening of the reply if one is
    to be generated."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(before_role),
            m["role"],
            F.lit(after_role),
            m["content"],
            F.lit(after_content),
        ),
    )
    return F.concat(F.array_join(turns, ""), F.lit(generation_prompt))


def length_budget(
    df: DataFrame,
    prompt_cap: int = PROMPT_WORD_CAP,
    completion_cap: int = COMPLETION_WORD_CAP,
) -> DataFrame:
    """Add word counts of prompt and completion and flags for those over their
    caps. Words stand in for model tokens, which need the model's tokenizer."""
    # Texts first, so that each is built once for the several looks at it.
    texts = df.withColumns(
        {
            "__prompt": F.array_join(F.col("prompt")["content"], " "),
            "__completion": completion_text(),
        }
    )
    counted = texts.withColumns(
        {
            "prompt_words": T.word_count(F.col("__prompt")),
            "completion_words": T.word_count(F.col("__completion")),
        }
    ).drop("__prompt", "__completion")
    return counted.withColumns(
        {
            "prompt_over": F.col("prompt_words") > prompt_cap,
            "completion_over": F.col("completion_words") > completion_cap,
        }
    )
