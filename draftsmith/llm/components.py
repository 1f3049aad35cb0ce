"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregates (smallest neighbour of a node) and two equi joins
back to the edges; nothing is collected and no group of neighbours is held.
Rounds are cut with ``checkpoint()``; their number grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftsmith.session import checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    x = e.join(least, "a")
    moved = x.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(x.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` (any order, repeats and loops allowed) to ``(node, root)``
    for every node with an edge to another; ``root`` is the smallest node of its
    component, which points to itself."""
    checkpoint_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    for _ in range(max_rounds):
        # done: each node has one parent and no parent has one itself
        roots = e.select(F.col("b").alias("p")).distinct()
        forks = e.groupBy("a").count().where("count > 1")
        if forks.isEmpty() and e.join(roots, e["a"] == roots["p"], "left_semi").isEmpty():
            tips = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(tips)
        e = _small_star(_large_star(e)).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
