"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from machlog.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of ``links`` (a, b).

    Each step is a minimum per node and a join; hubs are split by the skew join
    (both of its sides are written tables or plain exchanges).  The number of
    steps is logarithmic in the component sizes.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        edges = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = edges.join(least, "u")
        edges = cut(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(roots.select("node", F.col("node").alias("comp"))).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
