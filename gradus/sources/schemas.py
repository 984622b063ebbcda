"""Schemas of stored data."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE_TESTS = T.ArrayType(
    T.StructType(
        [T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]
    )
)

# Records as other tools write them: no keys besides the title.
PROBLEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("constraints", T.StringType()),
        T.StructField("input_format", T.StringType()),
        T.StructField("output_format", T.StringType()),
        T.StructField("sample_tests", SAMPLE_TESTS),
        T.StructField("solution", T.StringType()),
    ]
)

TASK_KEYS = ["contest_id", "task_id"]

# Records as this package collects them.
KEYED_PROBLEM = T.StructType(
    [T.StructField(k, T.StringType()) for k in TASK_KEYS] + PROBLEM.fields
)

TASK_PAGE = T.StructType(
    [T.StructField(k, T.StringType()) for k in (*TASK_KEYS, "html")]
)

SUBMISSION_PAGE = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("contest_id", "submission_id", "html")]
)

MESSAGES = T.ArrayType(
    T.StructType(
        [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
    )
)

COMPLETION = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("gen_id", T.IntegerType()),
        T.StructField("prompt", MESSAGES),
        T.StructField("completion", MESSAGES),
        T.StructField("answer", T.StringType()),
    ]
)
