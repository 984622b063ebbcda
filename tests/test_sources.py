import json

import pytest
from pyspark.sql import functions as F

from gradus.session import build_session, shared_path, spread
from gradus.sources import problems as S

RECORDS = [
    {
        "title": "A - é",
        "description": "d\n2",
        "constraints": "",
        "input_format": "i",
        "output_format": "o",
        "sample_tests": [{"input": "1", "output": "2"}],
        "solution": "int main() {}",
    },
    {"title": "B", "sample_tests": [], "solution": "x"},
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_array(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps(RECORDS, ensure_ascii=False, indent=2))
    for tolerant in (True, False):
        rows = S.read_problems(spark, path, tolerant=tolerant).orderBy("title").collect()
        assert [r.title for r in rows] == ["A - é", "B"]
        assert rows[0].sample_tests[0].output == "2"
        assert rows[1].description is None and rows[1].sample_tests == []


def _many(n):
    text = '"}\n  },\n  {\\ ]'
    return [
        {**RECORDS[i % 2], "title": f"{i} {text}", "solution": "x\\n  }" * (i % 7)} for i in range(n)
    ]


def _titles(df):
    return sorted((r.title, r.solution, str(r.sample_tests)) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "2048")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.json", json.dumps(_many(300), ensure_ascii=False, indent=2))
    whole = S.read_problems(spark, path)
    for tolerant in (True, False):
        split = S.read_problems(spark, path, indent=2, tolerant=tolerant)
        assert _titles(split) == _titles(whole) and split.count() == 300
        assert split.schema == S.PROBLEM
        with_rows = split.select(F.spark_partition_id()).distinct().count()
        assert whole.rdd.getNumPartitions() == 1 < 20 < with_rows
    assert S.malformed_records(spark, path, fmt="json", indent=2).count() == 0
    # Records are split by the reader: none is shuffled.
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(
    "text",
    [
        "[]",
        "[\n]\n",
        json.dumps(_many(9)),
        json.dumps(_many(9), indent=4),
        json.dumps(_many(9), indent=1),
        json.dumps(_many(9), indent=0),
        json.dumps(_many(9), indent=2).replace("\n", "\r\n"),
        json.dumps([{}, {}, RECORDS[0], {}], indent=2),
        "[" + ",\n".join(json.dumps(r) for r in _many(9)) + "]",
    ],
)
def test_any_layout_is_read_right(spark, tmp_path, small_splits, text):
    path = write(tmp_path / "a.json", text)
    rows = sorted(
        (r.title or "", r.solution or "") for r in S.read_problems(spark, path, indent=2).collect()
    )
    assert rows == sorted((r.get("title", ""), r.get("solution", "")) for r in json.loads(text))
    assert S.malformed_records(spark, path, fmt="json", indent=2).count() == 0


def test_a_broken_array_is_left_out_whole(spark, tmp_path, small_splits):
    good = json.dumps(_many(60), indent=2)
    write(tmp_path / "good.json", good)
    write(tmp_path / "cut.json", good[: len(good) // 2])
    write(tmp_path / "open.json", good[:-2])
    write(tmp_path / "kind.json", good.replace('"sample_tests": []', '"sample_tests": 7', 1))
    write(tmp_path / "twice.json", good + good)
    write(tmp_path / "text.json", "not json")
    path = str(tmp_path)
    assert S.read_problems(spark, path, indent=2).count() == 60
    dead = S.malformed_records(spark, path, fmt="json", indent=2).collect()
    names = sorted(r.file.rsplit("/", 1)[1] for r in dead)
    assert set(names) == {"cut.json", "kind.json", "open.json", "text.json", "twice.json"}
    assert [r.record for r in dead if r.file.endswith("open.json")] == [None]
    assert all("7" in r.record for r in dead if r.file.endswith("kind.json"))
    with pytest.raises(Exception, match="malformed JSON array"):
        S.read_problems(spark, path, indent=2, tolerant=False).collect()
    missing = str(tmp_path / "none")
    assert S.read_problems(spark, missing, indent=2).count() == 0
    assert S.malformed_records(spark, missing, fmt="json", indent=2).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_problems(spark, missing, indent=2, tolerant=False)


def test_missing_and_malformed(spark, tmp_path):
    missing = str(tmp_path / "none.json")
    assert S.read_problems(spark, missing).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_problems(spark, missing, tolerant=False)
    bad = write(tmp_path / "bad.json", json.dumps(RECORDS)[:-20])
    empty = S.read_problems(spark, bad)
    assert empty.count() == 0 and "_corrupt_record" not in empty.columns
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        S.read_problems(spark, bad, tolerant=False).collect()
    lines = write(tmp_path / "bad.jsonl", json.dumps(RECORDS[0]) + "\n{oops\n")
    # One bad line costs one record, and is kept as a dead letter.
    assert [r.title for r in S.read_problems(spark, lines, fmt="jsonl").collect()] == ["A - é"]
    dead = S.malformed_records(spark, lines).collect()
    assert [r.record for r in dead] == ["{oops"] and dead[0].file.endswith("bad.jsonl")
    assert [r.file[-8:] for r in S.malformed_records(spark, bad, fmt="json").collect()] == ["bad.json"]
    assert S.malformed_records(spark, missing).count() == 0


@pytest.mark.parametrize("fmt", ["jsonl", "parquet", "orc"])
def test_write_and_append(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    df = spark.createDataFrame(RECORDS, S.PROBLEM)
    S.write_problems(df, path, fmt=fmt)
    S.write_problems(df.where("title = 'B'"), path, fmt=fmt)
    back = S.read_problems(spark, path, fmt=fmt)
    assert sorted(r.title for r in back.collect()) == ["A - é", "B", "B"]
    assert back.schema == S.PROBLEM
    assert S.read_problems(spark, path + "-none", fmt=fmt).count() == 0


def test_written_json_keeps_text_as_it_is(spark, tmp_path):
    path = tmp_path / "out"
    S.write_problems(spark.createDataFrame(RECORDS[:1], S.PROBLEM), str(path), fmt="jsonl")
    text = "".join(p.read_text(encoding="utf-8") for p in path.glob("part-*"))
    assert json.loads(text) == RECORDS[0] and "é" in text


def test_append_and_count(spark):
    old = spark.createDataFrame([("a", 1)], "title string, n int")
    new = spark.createDataFrame([("a",), ("b",)], "title string")
    both = S.append_records(old, new)
    assert sorted((r.title, r.n) for r in both.select("title", F.coalesce("n", F.lit(0)).alias("n")).collect()) == [
        ("a", 0), ("a", 1), ("b", 0)]
    assert S.dataset_count(both).first().records == 3
    assert {r.title: r.records for r in S.dataset_count(both, "title").collect()} == {"a": 2, "b": 1}


def test_shared_folder_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_path(spark, "x").startswith(folder.rstrip("/"))
    assert build_session() is not None


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, numPartitions=cores)
    assert spread(wide) is wide
    assert spread(spark.range(0, 1000, numPartitions=1), "id").rdd.getNumPartitions() == 3 * cores


def test_no_shared_folder_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from gradus.session import shared_dir

    made = []
    context = SimpleNamespace(
        master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=made.append
    )
    session = SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
    session.conf["spark.checkpoint.dir"] = str(tmp_path)
    assert shared_dir(session) == str(tmp_path) and made == [str(tmp_path)]
