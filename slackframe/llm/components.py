"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the same key, so a node of very many neighbours is
pre-aggregated and its join side can be split; nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.llm.common import written


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node among the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    tied = down.join(low, down["a"] == low["u"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root) for every node of an edge; root is the least node of its component."""
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        edges = written(_small(_large(edges).distinct()).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
