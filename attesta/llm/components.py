"""Connected components of a graph given by its edges, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import shared_table


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (columns ``a``, ``b``, long); root is the smallest node of its component.

    Large-star and small-star rounds: every node hands its smallest neighbour to the larger (then the smaller) neighbours,
    until each node is linked with its root only. Minima are combined before the shuffle, so a node with very many
    neighbours is no single task's work; a chain takes a number of rounds that grows with the logarithm of its length.
    """
    edges = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shared_table(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = shared_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
