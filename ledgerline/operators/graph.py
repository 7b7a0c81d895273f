"""Breadth-first search over relationship edges, treated as undirected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget_of(depth: int, wanted: int = 200) -> int:
    return max(1, min(wanted, 500, 100 * (5 - depth)))


def bfs(edges: DataFrame, start: str, depth: int = 2, budget: int = 200) -> DataFrame:
    """node, level of what is reached from ``start``: at most ``budget`` nodes, filled level by level in the order of the node's name.

    edges: a, b. Each level is a join of the frontier (bounded by the budget) and an anti-join against what was visited.
    """
    depth = max(1, min(4, depth))
    left = budget_of(depth, budget) - 1
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0)], f"node {kind}, level int")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    for level in range(1, depth + 1):
        if left <= 0:
            break
        frontier = F.broadcast(seen.filter(F.col("level") == level - 1).select(F.col("node").alias("a")))
        found = both.join(frontier, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(F.broadcast(seen), "node", "left_anti")
        rows = found.orderBy("node").limit(left).collect()  # never more than the budget, 500
        if not rows:
            break
        left -= len(rows)
        seen = spark.createDataFrame([*[(r["node"], r["level"]) for r in seen.collect()], *[(r["node"], level) for r in rows]], f"node {kind}, level int")
    return seen


def bfs_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between reached nodes, each once."""
    own = F.broadcast(nodes.select("node"))
    inside = edges.join(own.withColumnRenamed("node", "a"), "a", "left_semi").join(own.withColumnRenamed("node", "b"), "b", "left_semi")
    return inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
