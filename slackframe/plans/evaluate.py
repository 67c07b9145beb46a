"""Evaluation of models, snapshots and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.functions.special import number_text


def squared_error(ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """(node, degree, rank) against a truth of the same form: sum of squares, -1 if any degree differs."""
    t = truth.select("node", F.col("degree").alias("d"), F.col("rank").alias("r"))
    both = ranks.join(t, "node")
    sums = both.agg(F.coalesce(F.bool_or(F.col("degree") != F.col("d")), F.lit(False)).alias("off"), F.coalesce(F.sum((F.col("rank") - F.col("r")) * (F.col("rank") - F.col("r"))), F.lit(0.0)).alias("e"))
    return sums.select(F.when(F.col("off"), F.lit(-1.0)).otherwise(F.col("e")).alias("squared_error"))


def combined(*shards: DataFrame) -> DataFrame:
    """Rows of all shards, and how many of them each key has (one, if the shards are disjoint)."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.groupBy("tab", "rid").agg(F.count("*").alias("n_shards"), F.first("value").alias("value"))


def quality_over_time(walltimes: DataFrame, metrics: DataFrame) -> DataFrame:
    """(iter, seconds) with (iter, metric) as JSON lines; numbers are written out, and a line without one of them is null."""
    j = walltimes.join(metrics, "iter")
    parts = ('{"iter":', F.col("iter").cast("string"), ',"seconds":', number_text(F.round("seconds", 3)), ',"metric":', number_text(F.round("metric", 6)), "}")
    return j.select("iter", F.concat(*[F.lit(p) for p in parts]).alias("line"))


def crossings(series: DataFrame, target: str = "target") -> DataFrame:
    """(id, at, value, target), at from 0 -> where each monotone series crosses its target, NaN if it doesn't.

    The first value beyond the target is found and the place is interpolated from the one before it.
    """
    w = Window.partitionBy("id").orderBy("at")
    ends = series.groupBy("id").agg(F.min_by("value", "at").alias("front"), F.max_by("value", "at").alias("back"))
    rows = series.withColumn("before", F.lag("value").over(w)).join(ends, "id")
    falls, rises = F.col("front") > F.col("back"), F.col("front") < F.col("back")
    inside = (falls & (F.col("front") > F.col(target)) & (F.col("back") < F.col(target))) | (rises & (F.col("front") < F.col(target)) & (F.col("back") > F.col(target)))
    beyond = inside & F.when(falls, F.col("value") < F.col(target)).otherwise(F.col("value") > F.col(target))
    place = F.col("at") - 1 + (F.col(target) - F.col("before")) / (F.col("value") - F.col("before"))
    found = rows.withColumn("place", F.when(beyond, place)).groupBy("id").agg(F.min_by("place", F.when(F.col("place").isNotNull(), F.col("at"))).alias("crossing"))
    return found.withColumn("crossing", F.coalesce("crossing", F.lit(float("nan"))))
