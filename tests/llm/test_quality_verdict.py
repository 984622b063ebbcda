"""The query of the quality rules, all counts and verdicts, against plain Python."""

import re
from collections import Counter

from gradus.llm import quality_rules
from gradus.llm.common import table
from gradus.llm.queries import QUERIES


def counts_plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_marks": len(re.findall("[!?.,;:]", text)),
        "n_distinct_words": len(set(words)),
    }


def features_plain(c):
    def share(a, b):
        return c[a] / max(c[b], 1)

    return {
        "words": float(c["n_words"]),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
    }


def rejected(rules, x):
    return any(
        all(x[t.feature] >= t.bound if t.above else x[t.feature] <= t.bound for t in rule)
        for rule in rules
    )


def judged_plain(rules, rows):
    out = []
    for doc_id, text in rows:
        c = counts_plain(text)
        base = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        kept = not base and not rejected(rules, features_plain(c))
        out.append({"doc_id": doc_id, **c, "base_failed": base, "kept": kept})
    return out


def as_list(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


def test_query_equals_plain_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    assert 0 < len(rules) <= quality_rules.MAX_RULES
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = judged_plain(rules, rows)
    got = [r.asDict() for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect()]
    assert as_list(got) == as_list(want)
    assert {r["kept"] for r in want} == {True, False}


def test_bounds_repeats_nulls_and_long_texts(spark):
    """A value equal to a bound fits; the first fitting rule rejects; repeated rows give
    repeated results; nulls and empty texts have zero of everything."""
    test = quality_rules.Test
    rules = [
        (test("words", True, 12.0), test("digit_share", True, 0.5)),
        (test("distinct_share", False, 0.25),),
    ]
    rows = [
        (1, " ".join(["a1"] + [f"{chr(98 + i)}{i}" for i in range(11)])),
        (2, " ".join(f"w{i}" for i in range(11))),
        (3, "one two three four " * 4),
        (4, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))),
        (4, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))),
        (5, None),
        (None, ""),
        (6, "\n".join(f"line {i} of a text that goes on, and on" for i in range(20_000))),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.asDict() for r in quality_rules.judge(docs, rules).collect()]
    assert as_list(got) == as_list(judged_plain(rules, rows))
