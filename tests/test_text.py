import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from gradus.functions import constants as K
from gradus.functions import text as T

CASES = {
    "block": (
        lambda s: T.block(s, "answer"),
        {
            "a<answer>x</answer>b": "x",
            "<answer>x</answer><answer>y</answer>": "y",
            "<answer>x": "x",
            "x</answer>y": "x",
            "no tag": "no tag",
            "": "",
            None: None,
            "<answer>": "",
        },
    ),
    "extract_answer": (
        T.extract_answer,
        {"<answer>\n\u00a0 7 \u3000</answer>": "7", " plain\t": "plain"},
    ),
    "strip": (
        T.strip,
        {
            "\u00a0a b\u2003": "a b",
            "\x1c\x1fa\x85": "a",
            "\u200ba": "\u200ba",
            " \t\n": "",
            None: None,
        },
    ),
    "count_of": (
        lambda s: T.count_of(s, "aa"),
        {"aaaa": 2, "aaa": 1, "": 0, "a.a": 0, None: None},
    ),
    "count_of_pattern_characters": (
        lambda s: T.count_of(s, "a.*"),
        {"a.*a.*": 2, "abc": 0},
    ),
    "after_last": (
        lambda s: T.after_last(s, "\nx\n"),
        # Marks that share a newline: the second does not count.
        {"\nx\nx\n": "x\n", "ab": "ab", "\nx\n": ""},
    ),
    "find": (
        lambda s: T.find(s, "b"),
        {"abb": 1, "é😀b": 2, "a": -1, "": -1, None: None},
    ),
    "lower": (T.lower, {"ÀB": "àb", "İ": "i\u0307", "ΑΣ": "ας"}),
    "numbers": (
        T.numbers,
        {
            "1 22 1": ["1", "22", "1"],
            "a1 1a _1 é1 1": ["1"],
            "\u0663\u0664, 5": ["\u0663\u0664", "5"],
            "\u00b2": [],
            "3.14-5": ["3", "14", "5"],
            "": [],
            None: None,
        },
    ),
    "split_lines": (
        T.split_lines,
        {
            "": [],
            "a": ["a"],
            "a\n": ["a"],
            "a\n\n": ["a", ""],
            "\n": [""],
            "a\r\nb\rc\x0bd\x0ce": ["a", "b", "c", "d", "e"],
            "a\x1cb\x1db\x1ec\x85d\u2028e\u2029f": ["a", "b", "b", "c", "d", "e", "f"],
            "a\x1fb": ["a\x1fb"],
            None: None,
        },
    ),
    "nonempty_lines": (
        T.nonempty_lines,
        {" a \n\n\u00a0\n b\rc": ["a", "b\rc"], "": [], None: None},
    ),
    "word_count": (
        T.word_count,
        {"": 0, "  ": 0, "a": 1, " a\u2003b\n c ": 3, None: None},
    ),
    "phrase_hits": (
        lambda s: T.phrase_hits(s, ["think", "thinking", "edge case"]),
        {
            "thinking think": 3,
            "edge casedge case": 1,
            "edge case edge case": 2,
            "": 0,
            None: None,
        },
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_primitive(spark, name):
    build, cases = CASES[name]
    assert evaluate(spark, list(cases), build) == list(cases.values())


def test_whitespace_is_what_python_strips(spark):
    expected = {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert set(K.WHITESPACE_CHARS) == expected
    wrapped = [f"{c}x{c}" for c in sorted(expected)]
    assert set(evaluate(spark, wrapped, T.strip)) == {"x"}


def test_digit_class_is_what_python_calls_digits(spark):
    sample = [c for c in map(chr, range(0x20, 0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    got = evaluate(spark, sample, lambda s: s.rlike(rf"\A[{K.digit_class()}]\z"))
    assert got == [c.isdigit() for c in sample]


def test_line_ends_are_those_of_python(spark):
    sample = [f"a{chr(c)}b" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    got = evaluate(spark, sample, lambda s: F.size(T.split_lines(s)))
    assert got == [len(s.splitlines()) for s in sample]
