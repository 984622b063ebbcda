"""The registered queries on the small tables, and the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gradus.llm.common import table
from gradus.llm.oracle import ORACLES
from gradus.llm.queries import QUERIES

TABLES = "documents pages benchmark labels conversations".split()


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    assert got == expected and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_each(spark, sf_dir, name):
    source = "pages" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, sf_dir).count() == table(spark, sf_dir, source).count()


def test_pipeline(spark, sf_dir):
    """Every stage is a subset of the one before with the same columns."""
    docs = table(spark, sf_dir, "documents").cache()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > sizes[0] / 2
    mixed = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert mixed.keys() == {r.doc_id for r in docs.select("doc_id").collect()}
