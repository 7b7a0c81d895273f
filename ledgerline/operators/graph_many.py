"""Breadth-first searches from many starts at once.

One frontier table (source, node) holds all searches; a level is a join of it with the edges, and an anti-join with what each source has visited. The budget holds for each source: the nodes of a
level are numbered by name within their source, and those past what is left go. So the visited table has at most ``budget`` rows a source, and nothing is collected. For a search with a budget of n only
the first n neighbours of a node by name can matter: of these, a source that has visited k nodes finds at least n - k new ones, as many as it may still take. So a node with a large share of all edges
has n of them here.

Edges and labels are read as they come, once or twice for each level: a bitmap of the nodes in question, 8 bits or more for each, is broadcast and lets only the edges of a level's nodes into its shuffles.
So what a search shuffles and writes follows what it reaches, not all edges. The edges between reached nodes are looked up from the end with fewer of them, of which a node has at most the square root of
twice their number.

Defined results: edges are undirected and have a relationship; self-loops are left out; an edge of the same ends and relationship is there once, with the smaller end first. A source that has no edges, or
no label, is alone. Nodes without a label are not reached when labels are given. Null ends take no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.loads import shared_root
from .graph import budget_of

#: The largest budget there is, and so the neighbours of a node that searches look at.
MOST = 500
#: The bits of a bitmap: at least and at most, 32 MB as words and their numbers.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 28


def may_hold(df: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among the nodes (column node of a written table), and a few others: whoever joins them exactly drops those."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * nodes.count()).bit_length()))

    def slot(name: str) -> Column:
        return F.xxhash64(name).bitwiseAND(F.lit(bits - 1))

    def bit(name: str) -> Column:
        return F.expr(f"shiftleft(1L, cast(xxhash64(`{name}`) & 63L as int))")

    words = nodes.groupBy(F.shiftright(slot("node"), 6).alias("__word")).agg(F.bit_or(bit("node")).alias("__bits"))
    own = df.withColumns({"__at": F.shiftright(slot(column), 6), "__bit": bit(column)})
    return own.join(F.broadcast(words), (F.col("__at") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__bit")) != 0), "left_semi").drop("__at", "__bit")


class Graph:
    """Undirected edges (a, b, relationship). They and the labels are read for each level: tables that take long to make are better written first."""

    def __init__(self, edges: DataFrame, labels: DataFrame | None = None):
        self.spark = edges.sparkSession
        self.root = f"{shared_root(self.spark)}/graph-{uuid.uuid4().hex}"
        self.edges = edges.filter("a is not null and b is not null and a <> b").select("a", "b", "relationship")
        self.labels = labels.filter("node is not null").select("node", "label") if labels is not None else None

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _near(self, front: DataFrame, most: int, name: str) -> DataFrame:
        """a, b: the first ``most`` neighbours, by name, of the nodes of ``front``."""
        ends = self._save(front.select(F.col("a").alias("node")).distinct(), f"{name}-ends")
        turned = self.edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = may_hold(self.edges.select("a", "b"), "a", ends).unionByName(may_hold(turned, "a", ends))
        both = both.distinct().join(ends.withColumnRenamed("node", "a"), "a", "left_semi")
        if self.labels is not None:
            both = self._save(both, f"{name}-all")
            found = self._save(both.select(F.col("b").alias("node")).distinct(), f"{name}-found")
            both = both.join(may_hold(self.labels.select("node"), "node", found).withColumnRenamed("node", "b"), "b", "left_semi")
        place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        return both.withColumn("place", place).filter(F.col("place") <= most).select("a", "b")

    def search(self, sources: DataFrame, depth: int = 2, budget: int = 200) -> DataFrame:
        """source, node, level: at most ``budget`` nodes for each source (column node of ``sources``), the source among them."""
        depth = max(1, min(4, depth))
        most = budget_of(depth, budget)
        name = uuid.uuid4().hex
        starts = sources.filter("node is not null").select("node").distinct()
        seen = self._save(starts.select(F.col("node").alias("source"), "node", F.lit(0).alias("level")), f"{name}-0")
        for level in range(1, depth + 1):
            sizes = seen.groupBy("source").agg(F.count("*").alias("had")).filter(F.col("had") < most)
            front = seen.filter(F.col("level") == level - 1).join(sizes, "source", "left_semi").select("source", F.col("node").alias("a"))
            near = self._near(front, min(MOST, most), f"{name}-{level}")
            # what one source meets more than once is combined before it is shuffled
            found = front.join(near, "a").select("source", F.col("b").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti")
            place = F.row_number().over(Window.partitionBy("source").orderBy("node"))
            fresh = found.join(sizes, "source").withColumn("place", place).filter(F.col("place") <= most - F.col("had"))
            new = self._save(fresh.select("source", "node", F.lit(level).alias("level")), f"{name}-{level}")
            if new.isEmpty():
                break
            seen = seen.unionByName(new)
        return seen

    def between(self, seen: DataFrame) -> DataFrame:
        """source, a, b, relationship: the edges between what each source has reached, each once."""
        name = uuid.uuid4().hex
        own = seen.select("source", "node")
        nodes = self._save(own.select("node").distinct(), f"{name}-nodes")
        kept = may_hold(may_hold(self.edges, "a", nodes), "b", nodes)
        inside = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "relationship").distinct()
        for end in "ab":
            inside = inside.join(nodes.withColumnRenamed("node", end), end, "left_semi")
        inside = self._save(inside, f"{name}-inside")
        degree = inside.select("a").unionByName(inside.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n"))
        of = [degree.select(F.col("a").alias(end), F.col("n").alias(f"n_{end}")) for end in "ab"]
        sized = inside.join(of[0], "a").join(of[1], "b")
        small = F.when(F.struct("n_a", "a") <= F.struct("n_b", "b"), F.struct(F.col("a").alias("from"), F.col("b").alias("to"))).otherwise(F.struct(F.col("b").alias("from"), F.col("a").alias("to")))
        oriented = sized.select(small.alias("x"), "a", "b", "relationship").select("x.from", "x.to", "a", "b", "relationship")
        half = own.withColumnRenamed("node", "from").join(oriented, "from")
        return half.join(own.withColumnRenamed("node", "to"), ["source", "to"], "left_semi").select("source", "a", "b", "relationship")

    def named(self, seen: DataFrame) -> DataFrame:
        """The reached nodes with their labels; a source without one has none."""
        if self.labels is None:
            return seen
        nodes = self._save(seen.select("node").distinct(), f"{uuid.uuid4().hex}-nodes")
        labels = may_hold(self.labels, "node", nodes).groupBy("node").agg(F.min("label").alias("label"))
        return seen.join(labels, "node", "left").select("source", "node", "level", "label")
