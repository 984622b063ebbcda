"""The fifteen reward columns.

Each reward is a function of ``TextViews`` that gives one number per completion.
A null completion gives a null reward. Expressions are kept linear (no operand
is repeated across branches) and use JVM built-ins only, so a projection of all
of them is one pass over the text without Python and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions import constants as K
from gradus.functions import text as T
from gradus.functions.views import TextViews

Reward = Callable[[TextViews], Column]


def _award(text: Column, condition: Column, points: Column | float) -> Column:
    """``points`` if the condition holds, 0 if not, null for a null text. The
    condition stands in the expression once, so it is evaluated once."""
    return F.when(condition, points).when(text.isNotNull(), F.lit(0.0))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _present(condition: Column) -> Column:
    return condition.cast("int")


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


# --- Answer rewards ------------------------------------------------------------


def correctness(v: TextViews) -> Column:
    """10 when the extracted answer equals the reference answer."""
    return _award(v.content, v.extracted_answer == v.answer, 10.0)


def int_answer(v: TextViews) -> Column:
    """0.5 when the extracted answer is made of digit characters only."""
    digits = v.extracted_answer.rlike(rf"\A[{K.digit_class()}]++\z")
    return _award(v.content, digits, 0.5)


# --- Format rewards ------------------------------------------------------------


def strict_format(v: TextViews) -> Column:
    """Both blocks in the exact layout, one line each."""
    line = r"\n[^\n]*+\n"
    return _award(
        v.content,
        v.content.rlike(
            rf"\A{K.REASONING_OPEN}{line}{K.REASONING_CLOSE}\n"
            rf"{K.ANSWER_OPEN}{line}{K.ANSWER_CLOSE}\n\n?\z"
        ),
        0.5,
    )


def soft_format(v: TextViews) -> Column:
    """Both single-line blocks at the start of the text, then anything.

    The answer begins either on the first line, and then the earliest place that
    fits leaves the most room for its end, so no other needs trying; or on a
    later line, and then the reasoning ends its line. Written as these two cases
    the match takes linear time on any text.
    """
    open_r, close_r = K.REASONING_OPEN, K.REASONING_CLOSE
    same_line = rf"(?>[^\n]*?{close_r}[{K.WS_NOT_NEWLINE}]*+{K.ANSWER_OPEN})"
    later_line = (
        rf"[^\n]*{close_r}[{K.WS_NOT_NEWLINE}]*+\n[{K.WS}]*+{K.ANSWER_OPEN}"
    )
    pattern = rf"\A{open_r}(?:{same_line}|{later_line})[^\n]*?{K.ANSWER_CLOSE}"
    return _award(v.content, v.content.rlike(pattern), 0.5)


def xml_count(v: TextViews) -> Column:
    """Credit per tag that occurs exactly once in its layout, less a
    charge per character after the closing answer tag."""
    c = v.content

    def credit(once: Column) -> Column:
        return _award(c, once, 0.125)

    def charge(once: Column, length: Column) -> Column:
        return F.when(once, length * F.lit(0.001)).otherwise(F.lit(0.0))

    opened, closed = v.answer_opened_once, v.answer_closed_once
    # Added in this order so that the doubles come out the same everywhere.
    return (
        credit(T.count_of(c, f"{K.REASONING_OPEN}\n") == 1)
        + credit(T.count_of(c, f"\n{K.REASONING_CLOSE}\n") == 1)
        + credit(opened)
        - charge(opened, F.length(T.after_last(c, f"\n{K.ANSWER_CLOSE}\n")))
        + credit(closed)
        - charge(closed, F.length(T.after_last(c, f"\n{K.ANSWER_CLOSE}")) - 1)
    )


def format_adherence(v: TextViews) -> Column:
    """Rewards block lengths and layout if the tags are all there, in
    order, with enough text inside. The length term has no cap."""
    c = v.content
    reasoning_length = F.length(T.strip(v.reasoning))
    answer_length = F.length(v.extracted_answer)
    valid = _all(
        c.contains(K.REASONING_CLOSE),
        c.contains(K.ANSWER_CLOSE),
        c.contains(K.REASONING_OPEN),
        # First answer tag present and not before the first reasoning tag.
        T.find(c, K.ANSWER_OPEN) > T.find(c, K.REASONING_OPEN),
        reasoning_length >= 30,
        answer_length >= 5,
    )
    value = (F.lit(0.5) * reasoning_length + F.lit(0.5) * answer_length) / 100 + F.lit(
        5.0
    ) * xml_count(v)
    return _award(c, valid, value)


def strict_start(v: TextViews) -> Column:
    """-5 without an opening tag, 5 when only whitespace precedes it, else
    one point per 50 characters before it (a bonus, and without a cap)."""
    c = v.content
    return (
        F.when(~c.contains(K.REASONING_OPEN), F.lit(-5.0))
        .when(c.rlike(rf"\A[{K.WS}]*+{K.REASONING_OPEN}"), F.lit(5.0))
        .otherwise(T.find(c, K.REASONING_OPEN) / F.lit(50.0))
    )


def strict_output_format(v: TextViews) -> Column:
    """Each tag exactly once, in order, and nothing around the blocks.
    Text between the blocks is allowed."""
    c = v.content_stripped
    tags = (K.REASONING_OPEN, K.REASONING_CLOSE, K.ANSWER_OPEN, K.ANSWER_CLOSE)
    # The text is stripped, so "nothing around" means it starts and ends with
    # the outer tags.
    valid = _all(
        c.startswith(K.REASONING_OPEN),
        c.endswith(K.ANSWER_CLOSE),
        T.find(c, K.REASONING_CLOSE) < T.find(c, K.ANSWER_OPEN),
        *(T.count_of(c, tag) == 1 for tag in tags),
    )
    return _award(c, valid, 10.0)


# --- Code rewards --------------------------------------------------------------


def cpp_syntax(v: TextViews) -> Column:
    """3 points for each of the four C++ patterns found."""
    patterns = (p.replace("{ws}", f"[{K.WS}]") for p in K.CPP_PATTERNS)
    return _total(_present(v.content.rlike(p)) for p in patterns) * 3


def cpp_markdown(v: TextViews) -> Column:
    """5 for one clean C++ fence around the first answer, less a point per
    surplus fence, not below 0."""
    after_open = F.substring(
        v.content,
        F.instr(v.content, K.ANSWER_OPEN) + len(K.ANSWER_OPEN),
        F.length(v.content),
    )
    closed = v.content.contains(K.ANSWER_OPEN) & after_open.contains(K.ANSWER_CLOSE)
    inner = T.strip(T.before_first(after_open, K.ANSWER_CLOSE))

    # One-element arrays name intermediate values once: the lines, then the
    # fences on the first and last. Inner lines are looked at only if both have.
    def fences(lines: Column) -> Column:
        first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
        return F.when(
            F.size(lines) >= 3,
            F.struct(
                T.count_of(first, K.CPP_FENCE).alias("start"),
                T.count_of(last, K.FENCE).alias("end"),
                F.slice(lines, 2, F.size(lines) - 2).alias("inner"),
            ),
        )

    def stray(line: Column) -> Column:
        return line.contains(K.FENCE) & T.strip(line).isin(K.FENCE, K.CPP_FENCE)

    def points(n: Column) -> Column:
        surplus = (n["start"] - 1) + (n["end"] - 1) + F.size(F.filter(n["inner"], stray))
        return F.when(
            (n["start"] >= 1) & (n["end"] >= 1),
            F.greatest(F.lit(0.0), F.lit(5.0) - surplus),
        ).otherwise(F.lit(0.0))

    lines = T.split_lines(inner, stripped=True)
    staged = F.transform(F.transform(F.array(lines), fences), points)
    fenced = v.content.contains(K.CPP_FENCE) & closed
    return _award(v.content, fenced, F.get(staged, F.lit(0)))


# --- Reasoning rewards ---------------------------------------------------------


def reasoning_coherence(v: TextViews) -> Column:
    """A point per line that opens a step, a point per transition phrase
    present, and half a point for three lines or more with a ``>`` or ``-``."""
    block = v.reasoning_of_lower
    starts = "|".join(T.literal(s) for s in K.STEP_STARTS)
    # A newline in front makes every line, the first too, begin after one.
    steps = F.regexp_count(
        F.concat(F.lit("\n"), block), F.lit(rf"\n[{K.WS_NOT_NEWLINE}]*+(?:{starts})")
    )
    concepts = _total(_present(block.contains(p)) for p in K.TRANSITION_PHRASES)
    three_lines = block.rlike(rf"\A(?:[{K.WS}]*+[^{K.WS}][^\n]*+){{3}}")
    continued = T.contains_any(block, (">", "-")) & three_lines
    return (steps + concepts).cast("double") + _award(block, continued, 0.5)


def logical_consistency(v: TextViews) -> Column:
    """A closing word in the reasoning, plus half a point, up to one, for
    each number that reasoning and answer share."""
    closing = T.contains_any(v.reasoning_lower, K.CONCLUSION_TERMS)
    shared = F.size(
        F.array_intersect(T.numbers(v.answer_block_lower), T.numbers(v.reasoning_lower))
    )
    justified = F.when(closing, F.lit(1.0)).when(v.content.isNotNull(), F.lit(0.3))
    return justified + F.least(F.lit(1.0), shared * F.lit(0.5))


def cp_thinking(v: TextViews) -> Column:
    """0.2 per marker occurrence and 0.4 per distinct marker."""
    block = v.reasoning_lower
    distinct = _total(_present(block.contains(p)) for p in K.THINKING_MARKERS)
    return T.phrase_hits(block, K.THINKING_MARKERS) * F.lit(0.2) + distinct * F.lit(0.4)


def answer_confidence(v: TextViews) -> Column:
    """Weighted count of confidence words anywhere in the lower-cased text.
    A listed phrase with a capital letter can never occur there."""
    reachable = {p: w for p, w in K.CONFIDENCE_INDICATORS.items() if p == p.lower()}
    terms = (T.count_of(v.content_lower, p) * F.lit(w) for p, w in reachable.items())
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def introspection(v: TextViews) -> Column:
    """0.5 per phrase occurrence in a tagged reasoning block, up to 10."""
    tagged = v.content.contains(K.REASONING_OPEN) & v.content.contains(
        K.REASONING_CLOSE
    )
    hits = T.phrase_hits(v.reasoning_lower, K.INTROSPECTION_PHRASES)
    return _award(v.content, tagged, F.least(hits * F.lit(0.5), F.lit(10.0)))


# name -> (reward, views it reads besides content and answer)
BUILT_IN: dict[str, tuple[Reward, tuple[str, ...]]] = {
    "correctness": (correctness, ("extracted_answer",)),
    "int_answer": (int_answer, ("extracted_answer",)),
    "strict_format": (strict_format, ()),
    "soft_format": (soft_format, ()),
    "xml_count": (xml_count, ("answer_opened_once", "answer_closed_once")),
    "format_adherence": (
        format_adherence,
        ("reasoning", "extracted_answer", "answer_opened_once", "answer_closed_once"),
    ),
    "cpp_syntax": (cpp_syntax, ()),
    "reasoning_coherence": (reasoning_coherence, ("reasoning_of_lower",)),
    "logical_consistency": (
        logical_consistency,
        ("reasoning_lower", "answer_block_lower"),
    ),
    "cp_thinking": (cp_thinking, ("reasoning_lower",)),
    "answer_confidence": (answer_confidence, ("content_lower",)),
    "strict_start": (strict_start, ()),
    "introspection": (introspection, ("reasoning_lower",)),
    "strict_output_format": (strict_output_format, ("content_stripped",)),
    "cpp_markdown": (cpp_markdown, ()),
}

ALL = tuple(BUILT_IN)

# The nine that make up the training score, in the order they are added.
ACTIVE = (
    "format_adherence",
    "correctness",
    "cp_thinking",
    "reasoning_coherence",
    "strict_start",
    "cpp_syntax",
    "introspection",
    "strict_output_format",
    "cpp_markdown",
)
