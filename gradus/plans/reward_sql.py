"""The rewards and text primitives once more, as SQL for the checking engine.

Written from the rules alone with that engine's own list and regex functions, so
that a match with the Spark columns means something.
"""

from __future__ import annotations

from gradus.functions import constants as K
from gradus.plans.derived import COMPLETION_SQL


def text(value: str) -> str:
    """SQL expression for a text; control characters become ``chr(n)``."""
    pieces, run = [], ""
    for ch in value:
        if ch.isprintable():
            run += ch
            continue
        if run:
            pieces.append("'" + run.replace("'", "''") + "'")
            run = ""
        pieces.append(f"chr({ord(ch)})")
    if run or not pieces:
        pieces.append("'" + run.replace("'", "''") + "'")
    return pieces[0] if len(pieces) == 1 else "(" + "||".join(pieces) + ")"


WS_CHARS = text(K.WHITESPACE_CHARS)
LINE_END = rf"\r\n|[{K.char_class(K.LINE_END_RANGES)}]"


def strip(s: str) -> str:
    return f"trim({s}, {WS_CHARS})"


def block(s: str, tag: str) -> str:
    return f"split_part(split_part({s}, '<{tag}>', -1), '</{tag}>', 1)"


def count(s: str, sub: str) -> str:
    return (
        f"((length({s}) - length(replace({s}, {text(sub)}, ''))) // {len(sub)})"
    )


def has(s: str, sub: str) -> str:
    return f"contains({s}, {text(sub)})"


def hits(s: str, phrases) -> str:
    return "(" + " + ".join(count(s, p) for p in phrases) + ")"


def present(s: str, phrases) -> str:
    return "(" + " + ".join(f"CAST({has(s, p)} AS INT)" for p in phrases) + ")"


def tail(s: str, mark: str) -> str:
    return f"length(split_part({s}, {text(mark)}, -1))"


def numbers(s: str) -> str:
    return (
        rf"list_filter(regexp_extract_all({s}, '[\p{{L}}\p{{N}}_]+'), "
        rf"lambda w: regexp_full_match(w, '\p{{Nd}}+'))"
    )


def lines(s: str) -> str:
    return (
        f"list_filter(list_transform(string_split({s}, chr(10)), "
        f"lambda x: {strip('x')}), lambda x: x <> '')"
    )


def if_(condition: str, points: str) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0e0 END"


COMPLETIONS = f"""completions AS (
SELECT doc_id, lang, doc_id - doc_id % 2 AS prompt_id, doc_id % 2 AS gen_id, source,
  CAST(doc_id AS VARCHAR) AS answer, {COMPLETION_SQL} AS c
FROM documents)"""


def views_sql(source: str = "completions") -> str:
    """CTEs ``v`` (and its steps) with all derived texts of column ``c``."""
    return f"""v1 AS (
SELECT *, lower(c) AS cl, {block("c", "reasoning")} AS rz, {block("c", "answer")} AS an,
  {strip("c")} AS cs,
  CASE WHEN contains(c, '<answer>') AND contains(substr(c, instr(c, '<answer>') + 8), '</answer>')
  THEN {strip("split_part(substr(c, instr(c, '<answer>') + 8), '</answer>', 1)")} END AS code
FROM {source}),
v AS (
SELECT *, lower(rz) AS rzl, lower(an) AS anl, {strip("an")} AS ans, {strip("rz")} AS rzs,
  {block("cl", "reasoning")} AS rcl,
  CASE WHEN code = '' THEN [] ELSE regexp_split_to_array(code, '{LINE_END}') END AS code_lines
FROM v1)"""


XML = (
    f"({if_(count('c', '<reasoning>' + chr(10)) + ' = 1', '0.125e0')}"
    f" + {if_(count('c', chr(10) + '</reasoning>' + chr(10)) + ' = 1', '0.125e0')}"
    f" + {if_(count('c', chr(10) + '<answer>' + chr(10)) + ' = 1', '0.125e0')}"
    f" - {if_(count('c', chr(10) + '<answer>' + chr(10)) + ' = 1', tail('c', chr(10) + '</answer>' + chr(10)) + ' * 0.001e0')}"
    f" + {if_(count('c', chr(10) + '</answer>') + ' = 1', '0.125e0')}"
    f" - {if_(count('c', chr(10) + '</answer>') + ' = 1', '(' + tail('c', chr(10) + '</answer>') + ' - 1) * 0.001e0')})"
)

_START, _END = "trim(code_lines[1], {ws})", "trim(code_lines[-1], {ws})"
_START, _END = _START.format(ws=WS_CHARS), _END.format(ws=WS_CHARS)

REWARD_SQL = {
    "correctness": if_("ans = answer", "10e0"),
    "int_answer": if_(f"regexp_full_match(ans, '[{K.digit_class()}]+')", "0.5e0"),
    "strict_format": if_(
        r"regexp_matches(c, '\A<reasoning>\n[^\n]*\n</reasoning>\n<answer>\n[^\n]*\n</answer>\n\n?\z')",
        "0.5e0",
    ),
    "soft_format": if_(
        rf"regexp_matches(c, '\A<reasoning>[^\n]*</reasoning>[{K.WS}]*<answer>[^\n]*</answer>')",
        "0.5e0",
    ),
    "xml_count": XML,
    "format_adherence": if_(
        "contains(c, '<reasoning>') AND contains(c, '</reasoning>')"
        " AND contains(c, '<answer>') AND contains(c, '</answer>')"
        " AND instr(c, '<answer>') >= instr(c, '<reasoning>')"
        " AND length(rzs) >= 30 AND length(ans) >= 5",
        f"(0.5e0 * length(rzs) + 0.5e0 * length(ans)) / 100 + 5e0 * {XML}",
    ),
    "cpp_syntax": "CAST(3 * ("
    + " + ".join(
        f"CAST(regexp_matches(c, '{p.replace('{ws}', '[' + K.WS + ']')}') AS INT)"
        for p in K.CPP_PATTERNS
    )
    + ") AS INT)",
    "reasoning_coherence": (
        f"len(list_filter({lines('rcl')}, lambda x: "
        + " OR ".join(f"starts_with(x, '{s}')" for s in K.STEP_STARTS)
        + f")) + {present('rcl', K.TRANSITION_PHRASES)} + "
        + if_(
            f"len({lines('rcl')}) >= 3 AND (contains(rcl, '>') OR contains(rcl, '-'))",
            "0.5e0",
        )
    ),
    "logical_consistency": (
        "CASE WHEN "
        + " OR ".join(has("rzl", t) for t in K.CONCLUSION_TERMS)
        + " THEN 1e0 ELSE 0.3e0 END + least(1e0, 0.5e0 * "
        + f"len(list_intersect({numbers('anl')}, {numbers('rzl')})))"
    ),
    "cp_thinking": (
        f"{hits('rzl', K.THINKING_MARKERS)} * 0.2e0"
        f" + {present('rzl', K.THINKING_MARKERS)} * 0.4e0"
    ),
    "answer_confidence": "0e0 + "
    + " + ".join(
        f"{count('cl', p)} * {w}e0" for p, w in K.CONFIDENCE_INDICATORS.items()
    ),
    "strict_start": (
        "CASE WHEN NOT contains(c, '<reasoning>') THEN -5e0"
        f" WHEN {strip('split_part(c, ' + text('<reasoning>') + ', 1)')} = '' THEN 5e0"
        " ELSE (instr(c, '<reasoning>') - 1) / 50e0 END"
    ),
    "introspection": if_(
        "contains(c, '<reasoning>') AND contains(c, '</reasoning>')",
        f"least(0.5e0 * {hits('rzl', K.INTROSPECTION_PHRASES)}, 10e0)",
    ),
    "strict_output_format": if_(
        " AND ".join(
            f"{count('cs', t)} = 1"
            for t in ("<reasoning>", "</reasoning>", "<answer>", "</answer>")
        )
        + " AND instr(cs, '<reasoning>') < instr(cs, '</reasoning>')"
        " AND instr(cs, '</reasoning>') < instr(cs, '<answer>')"
        " AND instr(cs, '<answer>') < instr(cs, '</answer>')"
        f" AND {strip('split_part(cs, ' + text('<reasoning>') + ', 1)')} = ''"
        f" AND {strip('split_part(cs, ' + text('</answer>') + ', 2)')} = ''",
        "10e0",
    ),
    "cpp_markdown": if_(
        f"len(code_lines) >= 3 AND {has(_START, K.CPP_FENCE)} AND {has(_END, K.FENCE)}",
        f"greatest(0e0, 5e0 - ({count(_START, K.CPP_FENCE)} - 1)"
        f" - ({count(_END, K.FENCE)} - 1)"
        " - len(list_filter(code_lines[2:len(code_lines) - 1], "
        f"lambda x: {strip('x')} IN ('{K.FENCE}', '{K.CPP_FENCE}'))))",
    ),
}


def with_views(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([COMPLETIONS, views_sql(), *ctes]) + "\n" + select


def total_sql(names) -> str:
    return " + ".join(f"({REWARD_SQL[n]})" for n in names)
