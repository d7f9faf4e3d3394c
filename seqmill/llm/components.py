"""Connected components of an edge table, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of one ordered type -> ``(node, component)``, the least reachable node.

    Alternates the large-star and the small-star step (Kiveris et al. 2014,
    "Connected Components in MapReduce and Beyond"); every round is a few
    shuffles of at most as many rows as there are edges, and is checkpointed.
    A node's minimum is aggregated with a map-side combine and joined back, so a
    star with very many leaves is never gathered in one task.  Nodes without an
    edge do not appear.  No edges: an empty result.  Raises if ``max_rounds``
    rounds do not converge.
    """
    e = cut(_clean(edges.select("a", "b")))
    if e.isEmpty():
        return e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    for _ in range(max_rounds):
        big = _large_star(e)
        new = cut(_small_star(big))
        # stable when every edge is (root, leaf) and no leaf is a root
        leaves = new.select(F.col("b").alias("x"))
        doubled = new.groupBy("b").count().where("count > 1").limit(1)
        chained = new.select(F.col("a").alias("x")).join(leaves, "x", "left_semi").limit(1)
        e = new
        if doubled.isEmpty() and chained.isEmpty():
            roots = e.select(F.col("a").alias("node")).distinct()
            return (e.select(F.col("b").alias("node"), F.col("a").alias("component"))
                    .unionByName(roots.withColumn("component", F.col("node"))))
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def _clean(e: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return (e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (both.groupBy("a").agg(F.min("b").alias("m"))
             .select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return _clean(e.join(least, e["a"] == least["n"]).select(F.col("m").alias("a"), "b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges have a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
    moved = e.join(least, e["b"] == least["n"])
    return _clean(moved.select(F.col("m").alias("a"), F.col("a").alias("b"))
                  .unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))))
