"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in links ``a, b``: root is the smallest node that
    can be reached. Labels go to neighbours and then jump to their label's label, so
    the rounds grow with the logarithm of the longest path. Each round is stored."""
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")),
        "labels",
    )
    while True:
        near = both.join(labels, both.b == labels.node).select("a", "root")
        offered = near.groupBy("a").agg(F.min("root").alias("offer"))
        lower = labels.join(offered, labels.node == offered.a).select(
            "node", F.col("root").alias("old"), F.least("root", "offer").alias("root")
        )
        lower = stored(lower, "labels")
        heads = lower.select(F.col("node").alias("root"), F.col("root").alias("head"))
        jumped = stored(
            lower.join(heads, "root").select("node", "old", F.col("head").alias("root")),
            "labels",
        )
        discard(labels, lower)
        if jumped.where("root <> old").isEmpty():
            discard(both)
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
