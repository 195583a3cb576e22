"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least"))
    return (
        both.where("b > a").join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    handed = (
        edges.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
        .where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    return handed.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link; root is its component's smallest node.

    ``links`` has two columns ``a, b`` of one orderable type, in any direction, repeats allowed.
    Rounds go on until the stars stand still, which takes about log(diameter) of them. Each
    round pre-aggregates the smallest neighbour before its shuffle, and the join that follows
    is one that adaptive execution splits where a node has very many links.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
        edges = written(_small_star(_large_star(edges).distinct()).distinct())
