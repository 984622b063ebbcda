from pyspark.sql import functions as F


def evaluate(spark, texts, build):
    """Value of ``build(column)`` for each text, in order."""
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "i int, s string")
    out = df.select("i", build(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(out, key=lambda r: r.i)]
