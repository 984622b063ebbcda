import random

from pyspark.sql import functions as F

from gradus.operators import tasks as J


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_grid(spark):
    grid = J.task_grid(spark, 210, 300)
    assert grid.count() == 364
    got = rows(J.task_grid(spark, 9, 10, ["a", "ex"]), "contest_id", "task_id", "letter")
    assert got == [
        ("abc10", "abc10_a", "a"),
        ("abc10", "abc10_ex", "ex"),
        ("abc9", "abc9_a", "a"),
        ("abc9", "abc9_ex", "ex"),
    ]
    assert J.task_grid(spark, 5, 4).count() == 0


def test_urls(spark):
    keys = spark.createDataFrame(
        [("abc1", "abc1_a", "77")], "contest_id string, task_id string, submission_id string"
    )
    got = keys.select(
        J.problem_url("https://h"), J.submission_list_url("https://h"), J.submission_url("https://h")
    ).first()
    assert tuple(got) == (
        "https://h/contests/abc1/tasks/abc1_a",
        "https://h/contests/abc1/submissions"
        "?f.Task=abc1_a&f.LanguageName=C%2B%2B&f.Status=AC&f.User=",
        "https://h/contests/abc1/submissions/77",
    )


def test_skip_collected_equals_the_plain_rule(spark):
    rng = random.Random(5)
    titles = [
        "A - Sum (ABC210)", "A -x abc21", "B - abc9abc10", "a - abc210", "AA - abc210",
        "C- abc210", " A - abc210", "D - abcabc12x", "A -", "abc210", "", None,
        "B - xABC0210", "EX - abc3", "D - abc" + "9" * 40,
    ]
    titles += [
        f"{rng.choice('ABCDE')}{rng.choice([' - ', ' -', '- '])}"
        f"{rng.choice(['abc', 'ABC', 'abd'])}{rng.randrange(1, 330)}"
        for _ in range(200)
    ]
    existing = spark.createDataFrame([(t,) for t in titles], "title string")
    letters = ["a", "b", "c", "d", "ex"]
    grid = J.task_grid(spark, 1, 320, letters)
    got = {r.task_id for r in J.skip_collected(grid, existing).collect()}
    expected = {
        f"abc{n}_{letter}"
        for n in range(1, 321)
        for letter in letters
        if not any(
            t and t[: len(letter) + 2] == f"{letter.upper()} -" and f"abc{n}" in t.lower()
            for t in titles
        )
    }
    assert got == expected
    plan = J.skip_collected(grid, existing)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skip_collected_by_key_with_a_hot_key(spark):
    grid = J.task_grid(spark, 1, 3)
    existing = spark.range(5000).select(
        F.lit("abc2").alias("contest_id"), F.lit("abc2_b").alias("task_id")
    )
    left = J.skip_collected_by_key(grid, existing)
    assert left.count() == 11
    assert left.where("task_id = 'abc2_b'").count() == 0


def test_known_among(spark, monkeypatch):
    tasks = J.task_grid(spark, 1, 3)
    existing = spark.range(400).select(
        F.concat(F.lit("abc"), (F.col("id") % 50).cast("string")).alias("contest_id"),
        F.concat(F.lit("abc"), (F.col("id") % 50).cast("string"), F.lit("_b")).alias("task_id"),
    )
    expected = [("abc1", "abc1_b"), ("abc2", "abc2_b"), ("abc3", "abc3_b")]
    assert rows(J.known_among(tasks, existing), "contest_id", "task_id") == expected
    monkeypatch.setattr(J, "BROADCAST_ROWS", 2)
    assert rows(J.known_among(tasks, existing), "contest_id", "task_id") == expected


def test_first_accepted_and_filter(spark):
    df = spark.createDataFrame(
        [(1, 5, "AC", "C++", "x"), (1, 3, "WA", "C++", "y"), (1, 4, "AC", "Java", "z"),
         (2, 9, "AC", "C++", "u"), (2, 8, "AC", "C++", "v"), (3, 1, "AC", "C++", "w")],
        "task int, pos int, status string, language string, id string",
    )
    kept = J.submission_filter(df, status=F.col("status"), language=F.col("language"))
    assert rows(J.first_accepted(kept, ["task"], "pos", "id"), "task", "pos", "id") == [
        (1, 5, "x"),
        (2, 8, "v"),
        (3, 1, "w"),
    ]
    one = J.submission_filter(
        df, status=F.col("status"), task=F.col("task"), want_task=2
    )
    assert one.count() == 2


def test_submission_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = J.submission_filter(events, status=F.col("event_type"), want_status="purchase")
    plan = kept.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_attach_solution(spark):
    problems = spark.createDataFrame(
        [("c", "1", "p1"), ("c", "2", "p2"), (None, "3", "p3")],
        "contest_id string, task_id string, description string",
    )
    solutions = spark.createDataFrame(
        [("c", "1", "s1"), ("c", "2", None), ("c", "4", "s4"), (None, "3", "s3")],
        "contest_id string, task_id string, solution string",
    )
    got = rows(J.attach_solution(problems, solutions), "task_id", "description", "solution")
    assert got == [("1", "p1", "s1")]


def test_one_per_key(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, at int, v string"
    )
    assert rows(J.one_per_key(df, ["k"], "at"), "k", "at") == [("a", 1), ("b", 1)]
    assert rows(J.one_per_key(df.drop("at"), ["k"]), "k") == [("a",), ("b",)]


def test_one_per_key_prefers_readable_copies(spark):
    rows = [("a", "x", None), ("a", "b", "broken"), ("b", "c", "broken"), ("b", "d", "worse")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, v string, error string")
        got = {r.k: (r.v, r.error) for r in J.one_per_key(df, ["k"], error="error").collect()}
        assert got == {"a": ("x", None), "b": ("c", "broken")}


def test_titles_with_long_numbers_and_several_prefixes(spark):
    long = "abc12345678901234567890"
    tasks = [(long, "a"), ("arc12", "a"), ("arc1", "a"), ("abc7", "a")]
    grid = J.with_letters(spark.createDataFrame([(c,) for c, _ in tasks], "contest_id string"), ["a"])
    titles = spark.createDataFrame([(f"A - x {long.upper()}",), ("A - x ARC12",)], "title string")
    left = {r.contest_id for r in J.skip_collected(grid, titles, ["abc", "arc"]).collect()}
    assert left == {"abc7"}


def test_copies_and_titles_in_collection(spark):
    from gradus.operators.collect import collect_increment, skip_pages_by_title

    good = (
        '<span class="h2">A - T</span><div id="task-statement"><span class="lang-en"><div class="part">'
        "<section><h3>Problem Statement</h3><p>p</p></section></div></span></div>"
    )
    broken = "<p>" * 100
    pages = [("abc1", "abc1_a", h) for h in (good, broken)] + [("abc2", "abc2_a", good)]
    lists = [(c, f"{c}_a", f'<table><tr><td><a href="/s/{c}1">d</a></td></tr></table>') for c in ("abc1", "abc2")]
    codes = [(c, f"{c}1", '<pre id="submission-code">int main(){}</pre>') for c in ("abc1", "abc2")]
    known = spark.createDataFrame([("A - old ABC2",)], "title string")
    for order in (pages, pages[::-1]):
        new = collect_increment(
            spark.createDataFrame(order, "contest_id string, task_id string, html string"),
            spark.createDataFrame(lists, "contest_id string, task_id string, html string"),
            spark.createDataFrame(codes, "contest_id string, submission_id string, html string"),
            known,
            skip_pages_by_title,
        )
        assert [(r.task_id, r.description) for r in new.collect()] == [("abc1_a", "p")]
        plan = new._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange" in line or "SortAggregate" in line:
                assert "html" not in line


def test_first_accepted_takes_one_row_of_a_tie(spark):
    rows_ = [("t", 1, "b", "x"), ("t", 1, "a", "y"), ("t", 2, "0", "0"), ("n", None, "q", "r"), ("t", None, "", "")]
    df = spark.createDataFrame(rows_, "task string, pos int, id string, code string")
    got = {r.task: tuple(r)[1:] for r in J.first_accepted(df, ["task"], "pos", "id", "code").collect()}
    assert got == {"t": (1, "a", "y"), "n": (None, None, None)}


def test_one_text_per_key_equals_one_per_key(spark, monkeypatch):
    rng = random.Random(7)
    rows_ = [
        (rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([1, 2, None]), rng.choice("xyz"), rng.choice([None, None, "broken", "worse"]))
        for _ in range(60)
    ]
    rows_ += [("hot", 1, "x", None)] * 300 + [("hot", 1, "x", "broken")] * 50 + [("alone", 1, "t", None), ("bad", 1, "t", "e")]
    schema = "k string, n int, v string, error string"
    for part in (rows_, rows_[-2:], [], [(None, None, None, None)] * 3, rows_[60:]):
        df = spark.createDataFrame(part, schema).repartition(5)
        want = sorted(map(repr, J.one_per_key(df, ["k", "n"], error="error").collect()))
        assert sorted(map(repr, J.one_text_per_key(df, ["k", "n"]).collect())) == want
        with monkeypatch.context() as patch:
            patch.setattr(J, "BROADCAST_ROWS", 0)
            assert sorted(map(repr, J.one_text_per_key(df, ["k", "n"]).collect())) == want
            assert sorted(map(repr, J.parsed_per_key(df, ["k", "n"], lambda d: d).collect())) == want
        assert sorted(map(repr, J.parsed_per_key(df, ["k", "n"], lambda d: d).collect())) == want


def test_copies_are_dropped_without_sorting_texts(spark, sf_dir):
    """Neither the plan of the result nor those of the jobs behind it aggregate texts by sort."""
    from gradus.plans import queries as Q

    plan = Q.collect_new(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    copies = spark.createDataFrame([("a", "x" * 50, None)] * 4 + [("a", "y", "broken"), ("b", "z", None)], "k string, v string, error string")
    plan = J.one_text_per_key(copies, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan and "Aggregate" not in plan
