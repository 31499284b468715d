"""Connected components of links between long numbers, by star contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b) links -> (node, root) for every linked node but the roots; root is the smallest node of its component.

    Large-star and small-star rounds alternate until nothing changes: each round hangs a node's larger neighbours, then its
    smaller ones, on the smallest it knows. Each round is written, so a lost executor costs a part of one round. Neighbours
    are never gathered in a list: a minimum for each node is joined back to its links, by broadcast where a node has many.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc")
        large = join_hot(both.filter("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "cc")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = join_hot(large, least, "a", "inner")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = written(small, "cc")
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
