import math
import statistics

import pytest
from pyspark.sql import functions as F

import gradus
from gradus.functions import registry
from gradus.functions.rewards import ACTIVE, ALL
from gradus.operators import prompts as P
from gradus.operators.scoring import group_advantage, reward_summary, score, total_reward
from gradus.plans.derived import completions

MESSAGE = "array<struct<role:string,content:string>>"


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(
        [
            (1, [("assistant", "<answer>4</answer>"), ("assistant", "later")], "4"),
            (2, [], "4"),
            (3, None, "4"),
            (4, [("assistant", None)], None),
        ],
        f"id int, completion {MESSAGE}, answer string",
    )


def test_score_reads_the_first_message(answers):
    got = {r.id: r for r in score(answers, ["correctness", "int_answer"]).collect()}
    assert (got[1].correctness, got[1].int_answer) == (10.0, 0.5)
    assert [got[i].correctness for i in (2, 3, 4)] == [None, None, None]


def test_score_keeps_the_other_columns(answers):
    assert score(answers).columns == [*answers.columns, *ACTIVE]
    assert score(answers.drop("answer"), ["int_answer"]).count() == 4


def test_unknown_reward(answers):
    with pytest.raises(KeyError, match="nope"):
        score(answers, ["nope"])


def test_total_and_weights(spark):
    df = spark.createDataFrame([(1.5, 3)], "a double, b int")
    assert total_reward(df, ["a", "b"]).first().total == 4.5
    weighted = total_reward(df, ["a", "b"], weights={"b": 2.0}, into="t").first()
    assert weighted.t == 7.5


def test_group_advantage_by_hand(spark):
    groups = {1: [1.0, 3.0], 2: [5.0], 3: [2.0, 2.0, 2.0], 4: [0.1, 0.2, 0.7, None], None: [1.0, 2.0]}
    data = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "prompt_id long, gen_id int, total double")
    got = {(r.prompt_id, r.gen_id): r.advantage for r in group_advantage(df).collect()}
    assert len(got) == len(data)
    for g, i, v in data:
        known = [x for x in groups[g] if x is not None]
        if v is None:
            assert got[g, i] is None
        elif len(known) < 2 or len(set(known)) == 1:
            assert got[g, i] == 0.0
        else:
            expected = (v - statistics.mean(known)) / statistics.stdev(known)
            assert math.isclose(got[g, i], expected, abs_tol=1e-12)


def test_group_advantage_uses_no_window(spark):
    # A third of all rows in one group: partial aggregation, no window.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("prompt_id"),
        (F.col("id") % 7).cast("double").alias("total"),
    )
    out = group_advantage(df)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    hot = out.where("prompt_id = -1").agg(F.avg("advantage"), F.stddev_samp("advantage")).first()
    assert abs(hot[0]) < 1e-9 and abs(hot[1] - 1) < 1e-9
    assert out.count() == 3000


def test_summary(spark):
    df = spark.createDataFrame(
        [("x", 0.0, 1), ("x", 2.0, 1), ("y", 5.0, None)], "k string, a double, b int"
    )
    got = {(r.k, r.reward): r for r in reward_summary(df, ["a", "b"], by=["k"]).collect()}
    assert got["x", "a"][2:] == (2, 1.0, math.sqrt(2), 0.0, 2.0, 0.5)
    assert got["x", "b"][2:] == (2, 1.0, 0.0, 1.0, 1.0, 1.0)
    assert got["y", "a"]["n"] == 1 and got["y", "a"]["std"] is None
    assert got["y", "b"]["n"] == 0 and got["y", "b"]["mean"] is None
    assert reward_summary(df, ["a"]).first()["n"] == 3


def test_registered_reward(answers):
    gradus.register_reward("length", lambda v: F.length(v.extracted_answer), ["extracted_answer"])
    try:
        assert score(answers, ["length"]).where("id = 1").first().length == 1
    finally:
        registry.unregister_reward("length")
    with pytest.raises(KeyError):
        registry.lookup("length")
    with pytest.raises(ValueError, match="no_view"):
        gradus.register_reward("x", lambda v: v.content, ["no_view"])


def test_python_reward(spark, answers):
    seen = []

    def rule(prompts, completions, answer, bonus, **kwargs):
        seen.append(1)
        assert len(prompts) == len(completions) == len(answer) == len(bonus)
        return [b + (c[0]["content"] == f"<answer>{a}</answer>") for c, a, b in zip(completions, answer, bonus)]

    one = answers.where("id = 1").withColumn("n", F.lit(2.0))
    value = gradus.batch_reward(
        rule, F.col("completion"), F.col("completion"), F.col("answer"), bonus=F.col("n")
    )
    assert one.select(value.alias("v")).first().v == 3.0


def test_each_reward_varies_on_the_derived_completions(spark, sf_dir):
    df = score(completions(spark, sf_dir), ALL)
    counts = df.agg(*(F.count_distinct(n).alias(n) for n in ALL)).first()
    assert all(counts[n] >= 2 for n in ALL), counts


def test_scoring_is_one_pass(spark, sf_dir):
    docs = completions(spark, sf_dir)
    plan = score(docs, ALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # only the repartition of the one-file scan
    assert "Python" not in plan


# --- Prompts -------------------------------------------------------------------


def test_build_prompt(spark):
    df = spark.createDataFrame([("d", "s", 1)], "description string, solution string, extra int")
    row = P.build_prompt(df).first()
    assert [m.role for m in row.prompt] == ["system", "user"]
    assert row.prompt[0].content.startswith("\nRespond in the following format:\n     <reasoning>\n")
    assert row.prompt[0].content.endswith("these sections.\n\n")
    assert (row.prompt[1].content, row.answer, row.extra) == ("d", "s", 1)
    assert P.build_prompt(df, "short").first().prompt[0].content == "short"


def test_messages(answers):
    got = {r[0]: r for r in answers.select("id", P.completion_text(), P.last_content("completion")).collect()}
    assert got[1][1:] == ("<answer>4</answer>", "later")
    assert got[2][1:] == got[3][1:] == (None, None)


def test_render_chat(answers):
    chat = P.render_chat(
        F.col("completion"), before_role="[", after_role="]", after_content=";", generation_prompt=">"
    )
    got = {r[0]: r[1] for r in answers.select("id", chat).collect()}
    assert got[1] == "[assistant]<answer>4</answer>;[assistant]later;>"
    assert got[2] == ">" and got[3] is None


def test_length_budget(spark):
    df = spark.createDataFrame(
        [([("system", "a b"), ("user", "c　d")], [("assistant", " x\ny ")])],
        f"prompt {MESSAGE}, completion {MESSAGE}",
    )
    row = P.length_budget(df, 4, 1).first()
    assert (row.prompt_words, row.completion_words) == (4, 2)
    assert (row.prompt_over, row.completion_over) == (False, True)


def test_best_of_group(spark):
    from gradus.operators.scoring import best_of_group

    rows = [(1, 0, 2.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, None), (3, 4, -1.0), (3, 5, None)]
    df = spark.createDataFrame(rows, "prompt_id bigint, gen_id int, total double")
    got = sorted(tuple(r) for r in best_of_group(df).collect())
    assert got == [(1, 1, 5.0), (3, 4, -1.0)]


def test_python_reward_may_be_null(spark):
    from gradus.functions.registry import batch_reward

    df = spark.createDataFrame([("a", "p", "x"), (None, "p", "y")], "c string, p string, a string")
    value = batch_reward(
        lambda prompts, completions, answer: [None if c is None else 1 for c in completions],
        F.col("p"), F.col("c"), F.col("a"),
    )
    assert sorted(r.v is None for r in df.select(value.alias("v")).collect()) == [False, True]
    short = batch_reward(lambda **k: [], F.col("p"), F.col("c"), F.col("a"))
    with pytest.raises(Exception, match="rewards for"):
        df.select(short.alias("v")).collect()


def test_best_of_group_with_any_item(spark):
    from gradus.operators.scoring import best_of_group

    rows = [(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "x", None), (2, "y", -1.0), (3, "z", None)]
    rows += [(4, "m", 5.0), (4, "n", float("nan")), (4, "k", float("inf"))]
    df = spark.createDataFrame(rows, "prompt_id int, gen_id string, total double")
    got = {r.prompt_id: (r.gen_id, r.total) for r in best_of_group(df).collect()}
    assert got.keys() == {1, 2, 4}
    assert got[1] == ("a", 2.0) and got[2] == ("y", -1.0) and got[4][0] == "n"
    days = spark.sql("SELECT 1 AS g, DATE'2024-01-02' AS d, 3 AS v UNION ALL SELECT 1, DATE'2024-01-01', 3")
    (best,) = best_of_group(days, "v", "g", "d").collect()
    assert str(best.d) == "2024-01-01" and best.v == 3


def test_a_failing_row_costs_its_own_reward(spark):
    from gradus.functions.registry import caught_reward, split_errors
    from gradus.operators.extract import quarantine

    def rule(prompts, completions, answer, **kwargs):
        if any(a == "7777" for a in answer):
            raise KeyError("no such answer")
        if "123" in answer:
            return [1.0]  # one value for however many rows
        return [None if a == "5" else "nan?" if a == "6" else float(a) for a in answer]

    text = F.col("id").cast("string")
    df = spark.range(0, 10_000, numPartitions=2).select(
        "id", caught_reward(rule, text, text, text).alias("value")
    )
    good, dead = quarantine(split_errors(df, "value"))
    dead = {r.id: r.error for r in dead.collect()}
    # A lone row gets its one value: only the bad answers fail.
    assert dead.keys() == {7777, 6}
    assert "no such answer" in dead[7777] and dead[6].startswith("ValueError")
    values = {r.id: r.value for r in good.collect()}
    assert len(values) == 9_998 and values[5] is None and values[123] == 1.0
    assert all(v == i for i, v in values.items() if i not in (5, 123))
    assert caught_reward(rule, text, text, text) is not None
    assert df.limit(0).count() == 0
