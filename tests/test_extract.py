"""Hand-written pages, one per branch of the extraction."""

import subprocess
import sys
import tracemalloc

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradus.functions import outline as outline_module
from gradus.functions.outline import outline, outlines, page_outline
from gradus.operators import extract as X

KEYS = "contest_id string, task_id string, html string"


def page(*parts, title='<span class="big h2"> A - Title\n</span>', lang="lang-en"):
    return (
        f'{title}<div id="task-statement"><span class="lang-ja"><div class="part">'
        "<section><h3>Problem Statement</h3><p>ja</p></section></div></span>"
        f'<span class="{lang}">{"".join(parts)}</span></div>'
    )


def part(header, body):
    return f'<div class="part"><section><h3>{header}</h3>{body}</section></div>'


STATEMENT = part("Problem Statement", "<p> one </p><p></p><p>t&amp;<b>wo</b></p>")
IN1 = part("Sample Input 1", "<div>x<pre> 1\n2 </pre></div>")
OUT1 = part("Sample Output 1", "<div><pre>3\n</pre></div>")


def records(spark, **pages):
    rows = [("c", name, html) for name, html in pages.items()]
    df = X.problem_records(X.page_parts(spark.createDataFrame(rows, KEYS)))
    return {r.task_id: r for r in df.collect()}


def samples(row):
    return [(s.input, s.output) for s in row.sample_tests]


def test_full_page(spark):
    got = records(
        spark,
        full=page(
            STATEMENT,
            part("Constraints", "<div> N &lt; 5 <p>q</p></div>"),
            part("Input Format", "<div>N</div><div>ignored</div>"),
            part("Output format", "<div>M</div>"),
            IN1,
            OUT1,
        ),
    )["full"]
    assert got.title == "A - Title"
    assert got.description == "one\n\nt&wo"
    assert got.constraints == "N < 5 q"
    assert (got.input_format, got.output_format) == ("N", "M")
    assert samples(got) == [("1\n2", "3")]
    assert got.error is None


def test_pages_that_are_no_problems(spark):
    assert not records(
        spark,
        empty="",
        no_statement='<span class="h2">t</span><div id="other"></div>',
        no_english=page(STATEMENT, lang="lang-fr"),
        no_title=page(STATEMENT, title=""),
        missing=None,
    )


def test_sections_that_do_not_count(spark):
    got = records(
        spark,
        no_section=page('<div class="part"><h3>Constraints</h3><div>x</div></div>'),
        no_header=page('<div class="part"><section><div>x</div></section></div>'),
        no_div=page(part("Constraints", "<p>x</p>")),
        input_only=page(part("Input", "<div>x</div>")),
        nothing=page(),
    )
    for row in got.values():
        assert (row.description, row.constraints, row.input_format) == ("", "", "")
        assert samples(row) == [] and row.error is None
    assert len(got) == 5


def test_classes_and_overwriting(spark):
    got = records(
        spark,
        both=page(part("Input/Output Format", "<div>io</div>")),
        last=page(
            part("Constraints", "<div>one</div>"), part("CONSTRAINTS!", "<div>two</div>")
        ),
        cleared=page(STATEMENT, part("problem statement", "<div>no p</div>")),
    )
    assert (got["both"].input_format, got["both"].output_format) == ("io", "")
    assert got["last"].constraints == "two"
    assert got["cleared"].description == ""


def test_samples(spark):
    got = records(
        spark,
        no_div=page(part("Sample Input 1", "<pre>1</pre>"), OUT1),
        not_followed=page(IN1, STATEMENT, OUT1),
        last=page(STATEMENT, IN1),
        between=page(IN1, "<p>note</p><div class='other'></div>", OUT1),
        no_pre=page(IN1, part("Sample Output 1", "<div>3</div>")),
        output_without_div=page(IN1, part("Sample Output 1", "<pre>3</pre>")),
        two=page(IN1, OUT1, IN1, OUT1),
        nested=page(f'<div class="part">{IN1}</div>', OUT1),
        in_statement=page(part("Problem Statement, Sample Input", "<pre>9</pre>"), OUT1),
    )
    counts = {k: len(samples(r)) for k, r in got.items()}
    assert counts == {
        "no_div": 0,
        "not_followed": 0,
        "last": 0,
        "between": 1,
        "no_pre": 0,
        "output_without_div": 1,
        "two": 2,
        # The wrapping part has no section of its own kind: the first section
        # inside it is IN1's, and its next sibling is the output.
        "nested": 1,
        "in_statement": 1,
    }


def test_failing_pages_are_quarantined(spark):
    rows = [
        ("c", "heading", page(IN1, '<div class="part"><section></section></div>')),
        ("c", "section", page(IN1, '<div class="part"><h3>Sample Output</h3></div>')),
        ("c", "fine", page(IN1, '<div class="part"><h3>Note</h3></div>')),
    ]
    df = X.problem_records(X.page_parts(spark.createDataFrame(rows, KEYS)))
    good, dead = X.quarantine(df)
    assert [r.task_id for r in good.collect()] == ["fine"]
    assert {r.task_id: r.error for r in dead.collect()} == {
        "heading": "no heading after sample input in part 0",
        "section": "no section after sample input in part 0",
    }
    assert "error" not in good.columns


def listed(spark, **pages):
    rows = [("c", name, html) for name, html in pages.items()]
    df = X.first_listed(X.listed_submissions(spark.createDataFrame(rows, KEYS)))
    return {r.task_id: (r.submission_id, r.error) for r in df.collect()}


def test_submission_lists(spark):
    head = "<table><tr><th>h</th><td><a href='/x/0'>0</a></td></tr>"
    got = listed(
        spark,
        plain=head + "<tr><td>x</td><td><a href='/s/12'>d</a><a href='/s/13'>e</a></td></tr>",
        later=head + "<tr><td>x</td></tr><tr><td><a href='/s/7'>d</a></td></tr>",
        earlier_cell="<tr><td><a href='/s/1'>d</a></td><td>x</td></tr>",
        empty_href="<tr><td><a href=''>d</a></td></tr><tr><td><a href='5'>d</a></td></tr>",
        no_href="<tr><td><a>d</a></td></tr><tr><td><a href='/6'>d</a></td></tr>",
        slash="<tr><td><a href='/s/'>d</a></td></tr><tr><td><a href='/s/8'>d</a></td></tr>",
        no_rows="<p>none</p>",
        bare="<tr>x</tr><tr><td><a href='/s/9'>d</a></td></tr>",
        bare_later="<tr><td><a href='/s/9'>d</a></td></tr><tr>x</tr>",
    )
    assert got == {
        "plain": ("12", None),
        "later": ("7", None),
        "earlier_cell": (None, None),
        "empty_href": ("5", None),
        "no_href": ("6", None),
        "slash": (None, None),
        "no_rows": (None, None),
        "bare": (None, "no cell in list row 0"),
        "bare_later": ("9", None),
    }


def test_submission_code(spark):
    rows = [
        ("c", "1", '<pre>no</pre><pre id="submission-code">\n#include &lt;a&gt;\n </pre>'),
        ("c", "2", "<pre>no</pre>"),
    ]
    df = X.submission_code(
        spark.createDataFrame(rows, "contest_id string, submission_id string, html string")
    )
    got = {r.submission_id: r.solution for r in df.collect()}
    assert got == {"1": "#include <a>", "2": None}


# --- The outline helper --------------------------------------------------------


def texts(html, tag):
    o = outline(html)
    return ["".join(o["pieces"][e["lo"] : e["hi"]]) for e in o["elements"] if e["tag"] == tag]


def test_outline_texts():
    assert texts("<p>a<p>b</p>c", "p") == ["abc", "b"]
    assert texts("<p>a</b></p>", "p") == ["a"]
    assert texts("<div><p>a</div>b", "p") == ["a"]
    assert texts("<p>a<br>b<br/>c</p>", "p") == ["abc"]
    assert texts("<p>a<script>x</script><style>y</style>b</p>", "p") == ["ab"]
    assert texts("<p>a<!-- c -->b</p>", "p") == ["ab"]
    assert texts("<p>&copy;&#65;&lt;</p>", "p") == ["\xa9A<"]
    assert texts("<p><b>a</b>  \t <b>b</b> \n <b>c</b></p>", "p") == ["a b\nc"]
    assert texts("<pre><b>a</b>  <b>b</b></pre>", "pre") == ["a  b"]
    assert texts("<p/>x<p>y", "p") == ["", "y"]


def test_outline_structure():
    o = outline('<div id=a class="x  y"><p>1</p><p>2</p></div><div></div>')
    div, p1, p2, after = o["elements"]
    assert (div["id"], div["classes"]) == ("a", ["x", "y"])
    assert (div["idx"], div["last"], p1["last"], after["last"]) == (0, 2, 1, 3)
    assert p1["parent"] == p2["parent"] != div["parent"] == after["parent"]
    assert outline(None) is None


def test_deep_unclosed_markup_is_linear():
    o = outline("<b>" * 20000 + "<p>x" + "</i>" * 20000)
    assert len(o["elements"]) == 1 and "".join(o["pieces"]) == "x"


def test_helper_travels_without_the_package():
    code = (
        "import pickle, sys; f = pickle.load(sys.stdin.buffer); "
        "print(*f('<p>a</p>')['pieces'], 'gradus' in sys.modules)"
    )
    done = subprocess.run(
        [sys.executable, "-c", code],
        input=cloudpickle.dumps(outline),
        capture_output=True,
        cwd="/",
        check=True,
    )
    assert done.stdout.decode().split() == ["a", "False"]


def test_extraction_needs_no_shuffle(spark):
    rows = [("c", "t", page(STATEMENT))]
    df = X.problem_records(X.page_parts(spark.createDataFrame(rows, KEYS)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    filtered = df.where(F.col("error").isNull() & (F.col("description") != ""))
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_light_html(spark):
    from gradus.functions import html as H

    page = (
        '<HTML LANG="en-US"><TITLE data-x="1">A &#38; B&nbsp;&#x1F600;</TITLE><body>'
        "<P class=\"x\"> one&#39;s <b>two</b> </P><p>three</p ><a class=\"b\" href='/u'>u</a>"
        '<A HREF="/v" id=z>v</A><abbr href="/no">w</abbr><p>open'
    )
    df = spark.createDataFrame([(page,), ("<p>a",), ("",), (None,)], "html string")
    c = F.col("html")
    rows = df.select(
        H.page_title(c).alias("t"), H.page_language(c).alias("l"),
        H.paragraphs(c).alias("p"), H.link_targets(c).alias("a"),
    ).collect()
    assert tuple(rows[0]) == ("A & B\xa0😀", "en", ["one's two", "three"], ["/u", "/v"])
    assert tuple(rows[1]) == (None, "", [], [])
    assert tuple(rows[2]) == (None, "", [], [])


def test_long_pages_take_linear_time(spark):
    import time

    body = "".join(f"<p>paragraph {i} of a page with some sixty characters in each</p>" for i in range(16_000))
    start = '<span class="h2">A - T</span><div id="task-statement"><span class="lang-en"><div class="part">'
    page = f"{start}<section><h3>Problem Statement</h3>{body}</section></div></span></div>"
    nested = page.replace("</p>", "")
    pages = spark.createDataFrame([("good", page), ("bad", nested)], "contest_id string, html string")
    pages = pages.withColumn("task_id", F.col("contest_id"))
    run = lambda: {r.task_id: r for r in X.problem_records(X.page_parts(pages)).collect()}
    run()
    began = time.perf_counter()
    got = run()
    assert time.perf_counter() - began < 6
    assert got["good"].description.count("\n") == 15_999 and got["good"].error is None
    assert "paragraphs within one another" in got["bad"].error


def test_paragraphs_left_open_at_any_depth(spark):
    opened = "".join(f"<p>a{i}" for i in range(65))
    expected = "\n".join("".join(f"a{i}" for i in range(k, 65)) for k in range(65))
    parts = [part("Problem Statement", opened), part("Constraints", f"<div>N{opened}</div>"), IN1, OUT1]
    rows = [("c", "t", page(*parts))]
    for statement_only in (False, True):
        parsed = X.page_parts(spark.createDataFrame(rows, KEYS), statement_only=statement_only)
        got = X.problem_records(parsed).first()
        assert got.error is None and got.title == "A - Title"
        assert got.description == expected
        assert got.constraints == "N" + expected.split("\n")[0]
        assert samples(got) == [("1\n2", "3")]
    table = f"<div>{opened}</div><table><tr><td><a href='/s/7'>x</a></td></tr></table>"
    listed = X.listed_submissions(spark.createDataFrame([("c", table)], "contest_id string, html string"))
    assert X.first_listed(listed).first()[1:] == ("7", None)


def test_light_extraction_is_linear(spark):
    """A megabyte of tags that never end, each kind in a few seconds at most."""
    import time

    from gradus.functions import html as H

    c = F.col("s")
    made = [
        H.page_title(c), H.page_title(c, "h1"), H.page_language(c), F.size(H.paragraphs(c)),
        F.size(H.link_targets(c)), F.length(H.plain_text(c)),
    ]
    for part in ("<a ", "<p ", "<x ", "<p>", "<title>", "<", "<a href=", "<p ></p "):
        df = spark.createDataFrame([(part * (1_000_000 // len(part)) + "</p>",)], "s string")
        start = time.perf_counter()
        df.select(*(m.alias(f"c{i}") for i, m in enumerate(made))).collect()
        assert time.perf_counter() - start < 12, part


def test_only_the_tags_asked_for(spark):
    from gradus.functions.outline import page_outline

    page = "<div><p>a</p><pre id='submission-code'>x</pre><table><tr><td><a href='u'>l</a></td></tr></table></div>"
    df = spark.createDataFrame([(page,)], "html string")
    (row,) = df.select(page_outline(F.col("html"), ("pre",)).alias("o")).collect()
    assert [e.tag for e in row.o.elements] == ["pre"]
    assert "".join(row.o.pieces[row.o.elements[0].lo : row.o.elements[0].hi]) == "x"


def test_a_batch_of_pages_is_outlined_in_slices(spark, monkeypatch):
    """No more pages are Python objects at once than a slice holds, a long one alone."""
    monkeypatch.setattr(outline_module, "SLICE_BYTES", 60)
    texts = ["<p>a</p>", None, "", "<p>é &lt; <b>b</b></p>", "<div>" + "long " * 40, "<p>z"] * 20
    found = list(outlines(pa.array(texts)))
    expected = pa.array([outline(t) for t in texts], type=found[0].type)
    assert pa.concat_arrays(found).equals(expected)
    at = 0
    for part in found:
        held = texts[at : at + len(part)]
        assert len(part) == 1 or sum(len((t or "").encode()) for t in held) <= 60
        at += len(part)
    assert list(outlines(pa.array([], pa.string()))) == []
    # The same through Spark: rows keep their pages, also where a task has none.
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, html string").repartition(3)
    rows = pages.select("i", page_outline(F.col("html")).alias("o")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = outline(texts[r.i])
        assert (r.o and r.o.pieces) == (expected and expected["pieces"])
        assert (r.o and [e.tag for e in r.o.elements]) == (
            expected and [e["tag"] for e in expected["elements"]]
        )


def test_python_objects_do_not_grow_with_the_pages_of_a_batch():
    """What a worker holds beside a batch is one slice's outlines, however many pages
    the batch has."""
    part = '<div class="part"><section><h3>Constraints</h3><p>%s</p></section></div>'
    page = part % ("word " * 600)

    def peak(n):
        pages = pa.array([page] * n)
        tracemalloc.start()
        try:
            rows = sum(len(o) for o in outlines(pages))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, low), (many, high) = peak(1_000), peak(4_000)
    assert (few, many) == (1_000, 4_000)
    assert high < 1.2 * low
