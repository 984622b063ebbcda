"""Text primitives as Column expressions.

Spark's own trimming, line splitting and regular expressions follow SQL or Java
rules; the functions here follow Unicode rules for whitespace, digits and line
ends. All stay on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.constants import (
    LINE_END_RANGES,
    WHITESPACE_CHARS,
    WS,
    char_class,
)

_LINE_END = rf"(?:\r\n|[{char_class(LINE_END_RANGES)}])"
_WORD = r"[\p{L}\p{N}_]"


def literal(text: str) -> str:
    """``text`` quoted for a Java regular expression."""
    return r"\Q" + text + r"\E"


def strip(s: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.btrim(s, F.lit(WHITESPACE_CHARS))


def after_last(s: Column, mark: str) -> Column:
    """Text after the last ``mark``, counting marks from the left without
    overlap; the whole text when there is none."""
    return F.split_part(s, F.lit(mark), F.lit(-1))


def before_first(s: Column, mark: str) -> Column:
    """Text before the first ``mark``; the whole text when there is none."""
    return F.substring_index(s, mark, 1)


def block(s: Column, tag: str) -> Column:
    """Text after the last ``<tag>`` and before the next ``</tag>``."""
    return before_first(F.substring_index(s, f"<{tag}>", -1), f"</{tag}>")


def extract_answer(s: Column) -> Column:
    return strip(block(s, "answer"))


def count_of(s: Column, sub: str) -> Column:
    """Occurrences of ``sub``, left to right without overlap."""
    return F.regexp_count(s, F.lit(literal(sub)))


def find(s: Column, sub: str) -> Column:
    """0-based position of the first ``sub``, -1 if absent."""
    return F.instr(s, sub) - 1


def lower(s: Column) -> Column:
    return F.lower(s)


def numbers(s: Column) -> Column:
    """Whole-word runs of decimal digits, any script, in text order."""
    return F.regexp_extract_all(
        s, F.lit(rf"(?=\p{{Nd}})(?<!{_WORD})\p{{Nd}}++(?!{_WORD})"), F.lit(0)
    )


def split_lines(s: Column, *, stripped: bool = False) -> Column:
    """Lines by every Unicode line end; a final line end opens no new line.

    ``stripped`` says that ``s`` is stripped and so has no final line end; an
    empty text then gives one empty line.
    """
    if stripped:
        return F.split(s, _LINE_END, -1)
    body = F.regexp_replace(s, _LINE_END + r"\z", "")
    return F.when(s == "", F.array().cast("array<string>")).when(
        s.isNotNull(), F.split(body, _LINE_END, -1)
    )


def nonempty_lines(s: Column) -> Column:
    """Lines by newline only, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(s, "\n", -1), strip), lambda x: x != "")


def word_count(s: Column) -> Column:
    """Number of whitespace-separated words: the gaps of the stripped text plus
    one. (Matching gaps is several times faster than matching words, because a
    negated class of many ranges is slow in the regex engine.)"""
    return F.regexp_count(strip(s), F.lit(f"[{WS}]++")) + (
        F.length(strip(s)) > 0
    ).cast("int")


def contains_any(s: Column, terms: Iterable[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | s.contains(term)
    return found


def phrase_hits(s: Column, phrases: Iterable[str]) -> Column:
    """Sum over the distinct ``phrases`` of their occurrences in ``s``.

    ``contains`` looks at the UTF-8 bytes and stops at the first hit; only texts
    that hold a phrase are decoded and counted. A phrase that includes another
    listed one is looked for only where the shorter one is.
    """
    phrases = sorted(dict.fromkeys(phrases), key=len)
    families: dict[str, list[str]] = {}
    for phrase in phrases:
        root = next((p for p in phrases if p in phrase), phrase)
        families.setdefault(root, []).append(phrase)
    total = F.lit(0)
    for root, members in families.items():
        counted = reduce(lambda a, b: a + b, (count_of(s, p) for p in members))
        total = total + F.when(s.contains(root), counted).when(
            s.isNotNull(), F.lit(0)
        )
    return total
