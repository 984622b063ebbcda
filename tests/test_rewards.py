"""One case per branch of each reward, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import rewards as R
from gradus.functions.registry import reward
from gradus.operators.scoring import score

GOOD = "<reasoning>\nr\n</reasoning>\n<answer>\na\n</answer>\n"
R30, A5 = "r" * 30, "a" * 5
LONG = f"<reasoning>\n{R30}\n</reasoning>\n<answer>\n{A5}\n</answer>"


def fenced(*lines):
    return "<answer>\n" + "\n".join(lines) + "\n</answer>"


def rz(text):
    return f"<reasoning>{text}</reasoning>"


# name -> list of (content, answer or None, value)
CASES = {
    "correctness": [
        ("<answer> 42\n</answer>", "42", 10.0),
        ("<answer>42</answer>", "42 ", 0.0),
        ("42", "42", 10.0),
        ("<answer>1</answer><answer>2</answer>", "2", 10.0),
        ("<answer>42</answer>", None, 0.0),
        (None, "42", None),
        ("", "", 10.0),
    ],
    "int_answer": [
        ("<answer>7</answer>", None, 0.5),
        ("<answer>\u00a0\u0663\u00b2\n</answer>", None, 0.5),
        ("<answer>-7</answer>", None, 0.0),
        ("<answer></answer>", None, 0.0),
        ("<answer>7.0</answer>", None, 0.0),
        ("<answer>\u00bd</answer>", None, 0.0),
        (None, None, None),
    ],
    "strict_format": [
        (GOOD, None, 0.5),
        (GOOD + "\n", None, 0.5),
        (GOOD + "\n\n", None, 0.0),
        (GOOD[:-1], None, 0.0),
        ("x" + GOOD, None, 0.0),
        (GOOD.replace("\nr\n", "\nr\ns\n"), None, 0.0),
        (GOOD.replace("\nr\n", "\nr\rs\u2028t\n"), None, 0.5),
        (GOOD.replace("\nr\n", "\n\n"), None, 0.5),
        (None, None, None),
    ],
    "soft_format": [
        ("<reasoning>r</reasoning> \n\u00a0<answer>a</answer> tail", None, 0.5),
        ("<reasoning>r</reasoning><answer></answer>", None, 0.5),
        (" <reasoning>r</reasoning><answer>a</answer>", None, 0.0),
        ("<reasoning>r\n</reasoning><answer>a</answer>", None, 0.0),
        ("<reasoning>r</reasoning>x</reasoning><answer>a</answer>", None, 0.5),
        ("<reasoning>r\rs</reasoning><answer>a</answer>", None, 0.5),
        (None, None, None),
    ],
    "xml_count": [
        # All four hit; nothing after the last mark: both charges are
        # 0 and -1 characters.
        (GOOD, None, 0.125 + 0.125 + 0.125 - 0 * 0.001 + 0.125 - 0 * 0.001),
        # No newline after the answer: the third charge is the whole text, and
        # an empty tail earns 0.001.
        (
            GOOD[:-1],
            None,
            0.125 + 0.125 + 0.125 - (len(GOOD) - 1) * 0.001 + 0.125 - -1 * 0.001,
        ),
        (GOOD + "bye", None, 0.125 + 0.125 + 0.125 - 3 * 0.001 + 0.125 - 3 * 0.001),
        ("none", None, 0.0),
        ("", None, 0.0),
        ("x\n</answer>abc", None, 0.125 - 2 * 0.001),
        ("<reasoning>\n<reasoning>\n", None, 0.0),
        # Two closing marks that share a newline count once.
        (
            "\n<answer>\n\n</answer>\n</answer>\n",
            None,
            0.125 - len("</answer>\n") * 0.001,
        ),
        (None, None, None),
    ],
    "format_adherence": [
        (
            LONG + "\n",
            None,
            (0.5 * 30 + 0.5 * 5) / 100 + 5 * (0.125 + 0.125 + 0.125 - 0.0 + 0.125 - 0.0),
        ),
        (LONG.replace(R30, R30[1:]), None, 0.0),
        (LONG.replace(A5, A5[1:]), None, 0.0),
        (LONG.replace("</reasoning>", ""), None, 0.0),
        (LONG.replace("</answer>", ""), None, 0.0),
        (LONG.replace("<reasoning>", ""), None, 0.0),
        (LONG.replace("<answer>", ""), None, 0.0),
        (f"<answer>{A5}</answer><reasoning>{R30}</reasoning>", None, 0.0),
        (f"<reasoning>{R30}</reasoning><answer>{A5}</answer>", None, 17.5 / 100 + 5 * 0.0),
        (None, None, None),
    ],
    "cpp_syntax": [
        ("#include\u00a0<x> using\nnamespace  std; std:: int main\t(", None, 12),
        ("#include<x>", None, 3),
        ("int mainly() usingnamespace std", None, 0),
        ("std::std::", None, 3),
        (None, None, None),
    ],
    "reasoning_coherence": [
        (rz("Step 1\n 2. x\n\u00a0finally - done"), None, 3.5),
        (rz("step\nb"), None, 1.0),
        (rz("a\nb\nc"), None, 0.0),
        (rz("a > b\nb\n\n\nc"), None, 0.5),
        (rz("a > b\n\n \nc"), None, 0.0),
        (rz("Problem Analysis, key observations, key observations"), None, 2.0),
        # Lower-cased before the block is taken, so capital tags count here.
        ("<REASONING>step</REASONING> step", None, 1.0),
        (rz("x\rstep"), None, 0.0),
        ("", None, 0.0),
        (None, None, None),
    ],
    "logical_consistency": [
        (rz("thus 7") + "<answer>7</answer>", None, 1.5),
        (rz("7 8 9") + "<answer>9 8 7</answer>", None, 1.3),
        (rz("7 7") + "<answer>7 7</answer>", None, 0.8),
        (rz("enthusiasm") + "<answer>7</answer>", None, 1.0),
        (rz("a") + "<answer>b</answer>", None, 0.3),
        (rz("é7 x7") + "<answer>7</answer>", None, 0.3),
        (None, None, None),
    ],
    "cp_thinking": [
        (rz("Algorithm Selection"), None, 2 * 0.2 + 2 * 0.4),
        (rz("edge case edge case"), None, 2 * 0.2 + 1 * 0.4),
        (rz("edge casedge case"), None, 1 * 0.2 + 1 * 0.4),
        (rz("x") + "algorithm", None, 0.0),
        ("", None, 0.0),
        (None, None, None),
    ],
    "answer_confidence": [
        ("Clearly, clearly maybe", None, 0.0 + 2 * 0.2 + 0 * 0.2 + 1 * 0.2),
        ("I think i think", None, 0.0),
        (None, None, None),
    ],
    "strict_start": [
        ("none", None, -5.0),
        ("<reasoning>", None, 5.0),
        (" \n\u00a0<reasoning>", None, 5.0),
        ("abcde <reasoning>", None, 6 / 50.0),
        ("x" * 500 + "<reasoning>", None, 10.0),
        ("<reasoning> <reasoning>", None, 5.0),
        (None, None, None),
    ],
    "introspection": [
        (rz("Thinking about it"), None, 1.5),
        (rz("oh my"), None, 1.0),
        (rz("consider " * 30), None, 10.0),
        ("<reasoning>think", None, 0.0),
        ("</reasoning>think<reasoning>", None, 0.0),
        (rz("estimatestimate"), None, 0.5),
        (None, None, None),
    ],
    "strict_output_format": [
        (GOOD, None, 10.0),
        ("\u3000" + GOOD + "\x1f", None, 10.0),
        (GOOD.replace("</reasoning>\n", "</reasoning>\nbetween"), None, 10.0),
        ("x" + GOOD, None, 0.0),
        (GOOD + "x", None, 0.0),
        (GOOD + "<answer>", None, 0.0),
        ("<reasoning><answer></reasoning></answer>", None, 0.0),
        ("<answer>a</answer><reasoning>r</reasoning>", None, 0.0),
        ("", None, 0.0),
        (None, None, None),
    ],
    "cpp_markdown": [
        (fenced("```cpp", "int x;", "```"), None, 5.0),
        (fenced("```cpp```cpp", "int x;", "``````"), None, 3.0),
        (fenced("```cpp", "```", " ```cpp ", "x", "```"), None, 3.0),
        (fenced("```cpp", "```"), None, 0.0),
        (fenced("```", "x", "```"), None, 0.0),
        (fenced("```cpp", "x", "y"), None, 0.0),
        (fenced("```cpp" * 9, "x", "```"), None, 0.0),
        ("```cpp\nx\n```", None, 0.0),
        ("<answer>```cpp\rx\u2028```</answer>", None, 5.0),
        # The first pair counts, not the last block.
        (fenced("```cpp", "x", "```") + "<answer>y</answer>", None, 5.0),
        ("<answer>y</answer>" + fenced("```cpp", "x", "```"), None, 0.0),
        ("<answer>", None, 0.0),
        ("</answer><answer>", None, 0.0),
        ("", None, 0.0),
        (None, None, None),
    ],
}


def test_every_reward_has_cases():
    assert set(CASES) == set(R.ALL)
    assert len(R.ALL) == 15 and len(R.ACTIVE) == 9


@pytest.mark.parametrize("name", R.ALL)
def test_reward_by_hand(spark, name):
    rows = [(i, c, a) for i, (c, a, _) in enumerate(CASES[name])]
    df = spark.createDataFrame(rows, "i int, c string, answer string")
    staged = score(df, [name], content=F.col("c"))
    inline = staged.withColumn("inline", reward(name, F.col("c"), F.col("answer")))
    got = sorted(inline.collect(), key=lambda r: r.i)
    expected = [v for _, _, v in CASES[name]]
    assert [r[name] for r in got] == expected
    assert [r["inline"] for r in got] == expected
