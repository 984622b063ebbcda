"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import shared_dir, shared_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, with no
    lineage, and safe when executors are lost."""
    spark = df.sparkSession
    shared_dir(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames from ``stored`` that nothing reads any more: what was
    made from them must be stored itself."""
    for df in frames:
        for path in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            conf = df.sparkSession._jsc.hadoopConfiguration()
            folder.getFileSystem(conf).delete(folder, True)


#: Most buckets of a table from ``stored_by``.
MOST_BUCKETS = 1 << 16


def stored_by(
    df: DataFrame, name: str, key: str, n_buckets: int, dealt: bool = False
) -> DataFrame:
    """Like ``stored``, dealt to buckets of ``key``: joins on it don't shuffle the rows
    again. ``dealt``: the rows come from such a table and lie in its buckets."""
    spark = df.sparkSession
    n_buckets = min(n_buckets, MOST_BUCKETS)
    path = shared_path(spark, name)
    table = "stored_" + path.rpartition("-")[2]
    rows = df if dealt else df.repartition(n_buckets, key)
    rows = rows.write.bucketBy(n_buckets, key).sortBy(key)
    rows.option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def buckets_for(total_bytes: int, per_bucket: int = 24 << 20) -> int:
    """How many buckets of about ``per_bucket`` bytes of text there are."""
    return max(8, -(-total_bytes // per_bucket))


def crc_mod(id_column, n: int):
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(n))


__all__ = [
    "WORD",
    "buckets_for",
    "crc_mod",
    "discard",
    "stored",
    "stored_by",
    "table",
    "text_bytes",
]
