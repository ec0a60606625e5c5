"""Connected components of an edge table by alternating large-star and small-star steps.

No step gathers a component: a step is an aggregation (the least neighbour of each node) and
a join back on the node, both of which Spark can split. Each step writes its edges to the
shared folder.

Nulls and odd input: edges with a null end, self-links and repeats are as if they weren't there;
an empty table gives an empty result; columns other than a and b are ignored. Steps go on until
labels settle (their number grows with the logarithm of the longest path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import drop_dir, fresh_dir


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    e = _both_ways(e)
    least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return e.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges in; one row (v, c) per node that is not the least of its
    component, c being the least. Self-links and repeats are fine."""
    spark = edges.sparkSession
    e = edges.where("a <> b")  # nulls go, too
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept: list[str] = []
    before = None
    while True:
        e = _small_star(_large_star(e)).where("a <> b").distinct()
        at = fresh_dir(spark, "components")
        e.write.parquet(at + "/edges")
        e = spark.read.parquet(at + "/edges")
        kept.append(at)
        # the sum of labels falls until every node points at the least of its component
        now = e.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
        if len(kept) > 2:
            drop_dir(spark, kept.pop(0))
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("c"))
        before = now
