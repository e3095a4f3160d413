"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the component's smallest node.

    Each step points nodes at the smallest neighbour; steps go on until the edges are stars, in about log2 of the longest
    path. Edges are written out after each step, so lost executors cost one step, and nothing is gathered but a count.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.col("at")).alias("m"))
        large = both.join(least, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "large-star", [edges])
        least = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("at"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()
        edges = staged(small, "small-star", [large])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(tops.select("node", F.col("node").alias("label")))
