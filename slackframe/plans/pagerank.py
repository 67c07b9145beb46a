"""PageRank as supersteps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackframe.plans.loop import iterate
from slackframe.storage import dealt, written

DAMPING = 0.85


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree of every node; repeated edges count, and nodes without edges out have 0."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(edges.select("dst", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("out").alias("degree"))


def initial(edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(node, degree, init, rank): 1 - damping where edges go out, else 0."""
    first = F.when(F.col("degree") > 0, F.lit(1 - damping)).otherwise(0.0)
    return degrees(edges).withColumn("init", first).withColumn("rank", F.col("init"))


def contributions(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """What each node receives over its edges in."""
    sent = nodes.where("degree > 0").select(F.col("node").alias("src"), (damping * F.col("rank") / F.col("degree")).alias("sent"))
    return edges.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("sent").alias("got"))


def rank(edges: DataFrame, iterations: int, damping: float = DAMPING) -> DataFrame:
    """(node, degree, init, rank) after so many supersteps. The mass of nodes without edges out is dropped.

    Equal edges are kept as one with a count, in buckets by source, so that a superstep moves ranks
    and contributions but no edge.
    """
    folded = dealt(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), "src", "edges")
    nodes = written(initial(edges, damping), "nodes")

    def step(state, _clock):
        sent = state.where("degree > 0").select(F.col("node").alias("src"), (damping * F.col("rank") / F.col("degree")).alias("sent"))
        got = folded.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("sent") * F.col("m")).alias("got"))
        return state.join(got, "node", "left").select("node", "degree", "init", (F.col("init") + F.coalesce("got", F.lit(0.0))).alias("rank"))

    return iterate(nodes, step, iterations, every=4)


def rank_by_deltas(edges: DataFrame, iterations: int, damping: float = DAMPING) -> DataFrame:
    """The same by sending over each edge only the change since its last contribution.

    All edges of a node last carried the same, so the node remembers it and the edges stay as they are.
    """
    nodes = written(initial(edges, damping).withColumn("sent", F.lit(0.0)), "nodes")
    links = dealt(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), "src", "edges")
    now = F.when(F.col("degree") > 0, damping * F.col("rank") / F.col("degree")).otherwise(0.0)
    for _ in range(iterations):
        change = nodes.where("degree > 0").select(F.col("node").alias("src"), (now - F.col("sent")).alias("delta"))
        got = links.join(change, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("delta") * F.col("m")).alias("got"))
        rank = F.col("rank") + F.coalesce("got", F.lit(0.0))
        nodes = written(nodes.join(got, "node", "left").select("node", "degree", "init", rank.alias("rank"), now.alias("sent")), "nodes")
    return nodes.drop("sent")


def accesses(edges: DataFrame, client, thread, vclock=None) -> DataFrame:
    """Each edge reads its source's row and writes its target's."""
    op = F.explode(F.array(F.struct(F.lit("READ").alias("op"), F.col("src").alias("rid")), F.struct(F.lit("WRITE").alias("op"), F.col("dst").alias("rid"))))
    return edges.select(client.alias("client"), thread.alias("thread"), op.alias("a")).select("client", "thread", "a.op", F.lit(0).cast("long").alias("tab"), "a.rid", F.lit(0).alias("slack"), F.lit(0).alias("vclock"))
