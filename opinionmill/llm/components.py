"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.tables import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    all_ = _both(edges)
    least = all_.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return all_.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").where("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of all nodes with an edge.

    ``edges`` has ``a`` and ``b``. Each turn joins edges to one row per node, so no
    component or neighbourhood is ever gathered; the driver sees one row a turn.
    """
    current = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    while True:
        current = written(_small_star(_large_star(current)).where("a != b").distinct(), "stars")
        # done once every node hangs on a root: no node is both child and parent
        parents = current.select(F.col("b").alias("n")).distinct()
        children = current.groupBy("a").agg(F.count("*").alias("c"))
        again = children.join(parents, children["a"] == parents["n"], "left_semi").select("a").union(
            children.where("c > 1").select("a"))
        if again.isEmpty():
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
