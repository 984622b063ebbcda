"""Reading and writing problem records and stored pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gradus.sources.schemas import KEYED_PROBLEM, PROBLEM

_CORRUPT = "_corrupt_record"


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """Read ``path``; a path that does not exist gives an empty frame."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_problems(
    spark: SparkSession,
    path: str,
    *,
    fmt: str = "json",
    tolerant: bool = True,
    schema: StructType = PROBLEM,
    indent: int | None = None,
) -> DataFrame:
    """Problem records from ``path``.

    ``fmt`` is ``json`` for files that each hold one JSON array, or ``jsonl`` /
    ``parquet`` / ``orc``. An array file is read by one task, unless ``indent`` says by
    how many spaces its records are indented: then it is split between records and
    read by many. A tolerant read gives an empty dataset for a missing
    path, leaves out malformed records (an array file is one record: it is read
    whole or not at all) and runs nothing when the plan is built; see
    ``malformed_records`` for what was left out. A strict read raises instead.
    """
    if fmt not in ("json", "jsonl"):
        if tolerant:
            return read_or_empty(spark, path, schema, fmt)
        return spark.read.schema(schema).format(fmt).load(path)
    if fmt == "json" and indent is not None:
        return _split_records(spark, path, indent, tolerant, schema)
    options = {"multiLine": fmt == "json"}
    if not tolerant:
        return spark.read.schema(schema).json(path, mode="FAILFAST", **options)
    df = _checked(spark, path, fmt, schema)
    return df.where(F.col(_CORRUPT).isNull() & _read_too(schema)).drop(_CORRUPT)


def _checked(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """Records with the text of malformed ones beside them."""
    return read_or_empty(
        spark,
        path,
        StructType([*schema.fields]).add(_CORRUPT, StringType()),
        "json",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=_CORRUPT,
        multiLine=fmt == "json",
    )


def _pieces(spark: SparkSession, path: str, indent: int) -> DataFrame:
    """``file, piece, items``: array files cut where a record ends, and the JSON texts
    of a piece's records; null if it holds something else.

    JSON has no line breaks within strings, so a line break, ``indent`` spaces and a
    brace only stand at the end of a record. Spark's text reader splits files at them
    as it does at line ends: nothing is shuffled, and a record over two splits is read
    by the first. A file of another layout stays one piece, the whole array.
    """
    end = "\n" + " " * indent + "}"
    lines = spark.read.option("lineSep", end).text(path)
    piece = F.trim("value", F.lit(" \t\r\n\ufeff"))

    def parsed(text: Column) -> Column:
        return F.from_json(text, "array<string>")

    # "[" begins the file, "," a later piece, "]" alone is what the last record leaves.
    starts = F.col("piece").rlike(r"\A(\[|\]\z|,\s*+[^,\]])")
    bare = F.when(F.col("piece") == "]", F.col("piece")).otherwise(F.substr("piece", F.lit(2)))
    body = F.concat(F.lit("["), bare)
    closed = F.when(F.endswith("piece", F.lit("]")), parsed(body))
    return (
        lines.select(F.col("_metadata.file_path").alias("file"), piece.alias("piece"))
        .where("piece <> ''")
        .withColumn("closed", F.when(starts, closed))
        .select(
            "file",
            "piece",
            F.startswith("piece", F.lit("[")).alias("opens"),
            F.col("closed").isNotNull().alias("closes"),
            F.coalesce(
                "closed", F.when(starts, parsed(F.concat(body, F.lit("}]"))))
            ).alias("items"),
        )
    )


def _checked_record(item: Column, schema: StructType) -> Column:
    """A record, with its text beside it where it is malformed."""
    return F.from_json(
        item,
        StructType([*schema.fields]).add(_CORRUPT, StringType()),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )


def _bad_items(schema: StructType) -> Column:
    return F.filter(
        "items", lambda item: _checked_record(item, schema)[_CORRUPT].isNotNull()
    )


def _broken_files(pieces: DataFrame, schema: StructType) -> DataFrame:
    """``file, failed``: array files that are not one array of records, and how many of
    their pieces and records failed. At most a row per input file, whose list the
    driver holds anyway, so it can be broadcast."""
    bad = F.when(F.col("items").isNull(), 1).otherwise(F.size(_bad_items(schema)))
    files = pieces.groupBy("file").agg(
        F.count_if("opens").alias("opens"),
        F.count_if("closes").alias("closes"),
        F.sum(bad).alias("failed"),
    )
    broken = files.where("opens <> 1 OR closes <> 1 OR failed > 0")
    return F.broadcast(broken.select("file", "failed"))


def _split_records(
    spark: SparkSession, path: str, indent: int, tolerant: bool, schema: StructType
) -> DataFrame:
    """Records of array files, read in pieces. Of a broken file a tolerant read gives
    nothing, as of one that is read whole; a strict one raises."""
    try:
        pieces = _pieces(spark, path, indent)
    except AnalysisException as error:
        if not tolerant or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    broken = _broken_files(pieces, schema)
    if tolerant:
        pieces = pieces.join(broken, "file", "left_anti")
    else:
        message = F.concat(F.lit("malformed JSON array: "), "file")
        good = F.when(F.col("failed").isNull(), True).otherwise(F.raise_error(message))
        pieces = pieces.join(broken, "file", "left").where(good.cast("boolean"))
    # Not "explode": its filter on the array would parse each piece once more.
    items = pieces.select(F.explode_outer("items").alias("item")).where("item IS NOT NULL")
    return items.select(F.from_json("item", schema).alias("record")).select("record.*")


def _read_too(schema: StructType):
    """Always true. Spark wants another column to be read beside the corrupt text."""
    return F.length(F.concat_ws("", F.col(schema.fieldNames()[0]).cast("string"))) >= 0


def malformed_records(
    spark: SparkSession,
    path: str,
    *,
    fmt: str = "jsonl",
    schema: StructType = PROBLEM,
    indent: int | None = None,
) -> DataFrame:
    """``file, record``: the dead letters of a tolerant JSON read. With ``indent`` they
    are the failing pieces and records of array files, or one null for a file whose
    brackets alone are wrong."""
    if fmt == "json" and indent is not None:
        try:
            pieces = _pieces(spark, path, indent)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "file string, record string")
        failing = F.when(F.col("items").isNull(), F.array("piece")).otherwise(_bad_items(schema))
        dead = pieces.select("file", F.explode(failing).alias("record"))
        frames = _broken_files(pieces, schema).where("failed = 0")
        return dead.unionByName(
            frames.select("file", F.lit(None).cast("string").alias("record"))
        )
    df = _checked(spark, path, fmt, schema)
    return df.where(F.col(_CORRUPT).isNotNull() & _read_too(schema)).select(
        F.input_file_name().alias("file"), F.col(_CORRUPT).alias("record")
    )


def write_problems(
    df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "append"
) -> None:
    """Append records as Parquet, ORC or JSON Lines (UTF-8, nothing escaped
    beyond what JSON needs)."""
    writer = df.write.mode(mode).format("json" if fmt == "jsonl" else fmt)
    if fmt in ("json", "jsonl"):
        writer = writer.option("ignoreNullFields", False)
    writer.save(path)


def append_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing records and new ones, duplicates kept."""
    return existing.unionByName(new, allowMissingColumns=True)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages: key columns and ``html``."""
    return spark.read.format(fmt).load(path)


def dataset_count(df: DataFrame, *by: str) -> DataFrame:
    """Number of records, in total or per slice."""
    return df.groupBy(*by).agg(F.count("*").alias("records"))


__all__ = [
    "KEYED_PROBLEM",
    "append_records",
    "dataset_count",
    "malformed_records",
    "read_or_empty",
    "read_pages",
    "read_problems",
    "write_problems",
]
