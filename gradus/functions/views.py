"""The handful of derived texts that all rewards look at.

Several rewards need the same lower-cased text or the same tag block. Spark does
not share such work between separate expressions inside conditionals, so the
scorer stages each view once as a column and hands the rewards references.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import text as T

# name -> (views it is made of, how). Order matters: later ones use earlier ones.
VIEWS = {
    "content_lower": (("content",), T.lower),
    "reasoning": (("content",), lambda c: T.block(c, "reasoning")),
    "answer_block": (("content",), lambda c: T.block(c, "answer")),
    "content_stripped": (("content",), T.strip),
    "answer_opened_once": (("content",), lambda c: T.count_of(c, "\n<answer>\n") == 1),
    "answer_closed_once": (("content",), lambda c: T.count_of(c, "\n</answer>") == 1),
    "reasoning_lower": (("reasoning",), T.lower),
    "answer_block_lower": (("answer_block",), T.lower),
    "extracted_answer": (("answer_block",), T.strip),
    # Lower-casing first lets <REASONING> count as a tag here, and only here.
    "reasoning_of_lower": (("content_lower",), lambda c: T.block(c, "reasoning")),
}


@dataclass(frozen=True)
class TextViews:
    """Attribute access to ``content``, ``answer`` and the derived views."""

    columns: dict[str, Column]

    def __getattr__(self, name: str) -> Column:
        try:
            return self.columns[name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def inline(cls, content: Column, answer: Column | None = None) -> TextViews:
        """All views as plain expressions, for scoring outside ``score``."""
        columns = {"content": content}
        columns["answer"] = F.lit(None).cast("string") if answer is None else answer
        for name, (sources, build) in VIEWS.items():
            columns[name] = build(*(columns[s] for s in sources))
        return cls(columns)


def _closure(needed: Iterable[str]) -> list[str]:
    wanted = set(needed)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted.update(VIEWS[name][0])
    return [name for name in VIEWS if name in wanted]


def stage_views(
    df: DataFrame, content: Column, answer: Column | None, needed: Iterable[str]
) -> tuple[DataFrame, TextViews, list[str]]:
    """Add the needed views as columns, one projection per dependency level.

    Returns the widened frame, references to the views, and the names of the
    added columns so that the caller can drop them.
    """
    prefix = "__view_"
    added = {"content": prefix + "content"}
    df = df.withColumn(added["content"], content)
    level = {"content": 0}
    by_level: dict[int, list[str]] = {}
    for name in _closure(needed):
        level[name] = 1 + max(level[s] for s in VIEWS[name][0])
        by_level.setdefault(level[name], []).append(name)
    for names in by_level.values():
        df = df.withColumns(
            {
                prefix + n: VIEWS[n][1](*(F.col(added[s]) for s in VIEWS[n][0]))
                for n in names
            }
        )
        added.update({n: prefix + n for n in names})
    views = {n: F.col(c) for n, c in added.items()}
    views["answer"] = F.lit(None).cast("string") if answer is None else answer
    return df, TextViews(views), list(added.values())
