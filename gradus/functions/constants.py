"""Fixed values. Results depend on these exact texts, so they are stated here
once, plainly and in their natural order, and used everywhere else by name."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# --- Fixed values: prompt text -------------------------------------------------

SYSTEM_PROMPT = """
Respond in the following format:
     <reasoning>
     ...your detailed internal monologue...
     </reasoning>
     <answer>
     ```cpp
     ...your final C++ code...
     ```
     </answer>
There should be no extra text or tags before, between, or after these sections.

"""

PROMPT_WORD_CAP = 256
COMPLETION_WORD_CAP = 512

# --- Fixed values: tags --------------------------------------------------------

REASONING_OPEN = "<reasoning>"
REASONING_CLOSE = "</reasoning>"
ANSWER_OPEN = "<answer>"
ANSWER_CLOSE = "</answer>"

# --- Fixed values: word lists and patterns of the rewards ----------------------

# R07. ``{ws}`` stands for one whitespace character of WHITESPACE below.
CPP_PATTERNS = (
    r"#include{ws}*<",
    r"using{ws}+namespace{ws}+std",
    r"std::",
    r"int{ws}+main{ws}*\(",
)

# R08
STEP_STARTS = ("step", "1.", "2.", "3.", "finally")
TRANSITION_PHRASES = (
    "problem analysis",
    "key observations",
    "algorithm chosen",
    "edge cases considered",
    "complexity analysis",
    "alternative approaches",
)

# R09
CONCLUSION_TERMS = ("therefore", "thus", "hence", "conclusion")

# R10
THINKING_MARKERS = (
    "time complexity",
    "space optimization",
    "edge case",
    "test input",
    "constraints analysis",
    "algorithm selection",
    "algorithm",
    "data structure",
)

# R11
CONFIDENCE_INDICATORS = {
    "clearly": 0.2,
    "obviously": 0.2,
    "definitely": 0.2,
    "conclusively": 0.2,
    "maybe": 0.2,
    "perhaps": 0.2,
    "possibly": 0.2,
    "I think": 0.2,
}

# R13
INTROSPECTION_PHRASES = (
    "think",
    "thinking",
    "wait",
    "we can do it",
    "this can be correct",
    "this can be done",
    "perhaps",
    "maybe",
    "let's try",
    "alternative",
    "consider",
    "upon reflection",
    "wonder",
    "let's examine",
    "thinking about",
    "after some thought",
    "suspect",
    "believe",
    "reflection",
    "it seems that",
    "conclude",
    "my",
    "hypothesize",
    "analyze",
    "reason",
    "considering",
    "possibility",
    "might be",
    "recall",
    "estimate",
    "deduce",
    "oh",
)

# R15
CPP_FENCE = "```cpp"
FENCE = "```"

# --- Fixed values: tasks -------------------------------------------------------

CONTEST_PREFIX = "abc"
TASK_LETTERS = ("a", "b", "c", "d")
SUBMISSION_LANGUAGE = "C++"
SUBMISSION_STATUS = "AC"

# --- Fixed values: character classes -------------------------------------------

# The 29 whitespace code points, as (first, last) ranges.
WHITESPACE_RANGES = (
    (0x0009, 0x000D),
    (0x001C, 0x0020),
    (0x0085, 0x0085),
    (0x00A0, 0x00A0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# Line ends; besides these, the pair U+000D U+000A counts as one.
LINE_END_RANGES = (
    (0x000A, 0x000D),
    (0x001C, 0x001E),
    (0x0085, 0x0085),
    (0x2028, 0x2029),
)


def char_class(ranges) -> str:
    """Body of a regular-expression class, valid for Java and RE2 alike."""
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"
        for lo, hi in ranges
    )


def _runs(code_points):
    """Merge sorted code points into (first, last) ranges."""
    runs: list[list[int]] = []
    for cp in code_points:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return [tuple(r) for r in runs]


WHITESPACE_CHARS = "".join(
    chr(cp) for lo, hi in WHITESPACE_RANGES for cp in range(lo, hi + 1)
)
WS = char_class(WHITESPACE_RANGES)
WS_NOT_NEWLINE = char_class(
    _runs(
        cp
        for lo, hi in WHITESPACE_RANGES
        for cp in range(lo, hi + 1)
        if cp != 0x0A
    )
)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Decimal digits plus the digit characters outside that category
    (superscripts, circled digits and so on), by rule from the Unicode data."""
    extra = (
        cp
        for cp in range(0x110000)
        if chr(cp).isdigit() and unicodedata.category(chr(cp)) != "Nd"
    )
    return r"\p{Nd}" + char_class(_runs(extra))
