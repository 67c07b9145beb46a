"""Multi-class logistic regression: examples (id, x, label), weights (label, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.functions.special import argmax, dot, safe_log, softmax
from slackframe.storage import map_arrow


def weight_matrix(weights: DataFrame) -> Column:
    """All weight rows, in order of their label, as one literal array. One row for each label: labels are few."""
    rows = sorted((r.label, list(r.w)) for r in weights.collect())
    return F.array(*[F.array(*[F.lit(float(v)) for v in w]) for _, w in rows])


def scored(examples: DataFrame, weights: DataFrame) -> DataFrame:
    """Examples with scores: the products of x with each label's weights."""
    w = weight_matrix(weights)
    return examples.withColumn("scores", F.transform(w, lambda row: dot(row, F.col("x"))))


def predicted(examples: DataFrame, weights: DataFrame) -> DataFrame:
    return scored(examples, weights).withColumn("p", softmax(F.col("scores")))


def judged(rows: DataFrame) -> DataFrame:
    """Rows with p -> 0/1 loss (the first of equal labels is said) and the log-likelihood of the right label."""
    right = F.element_at("p", (F.col("label") + 1).cast("int"))
    return rows.withColumn("said", argmax(F.col("p"))).withColumn("zero_one", (F.col("said") != F.col("label")).cast("int")).withColumn("log_likelihood", safe_log(right))


def batch_deltas(rows: DataFrame, rate: float) -> DataFrame:
    """Change of each weight over all rows at frozen weights: (label, k, value)."""
    y = F.transform("p", lambda v, i: v - F.when(i == F.col("label"), 1.0).otherwise(0.0))
    each = rows.select("x", F.posexplode(y).alias("l", "y")).select("l", "y", F.posexplode("x").alias("k", "v"))
    return each.groupBy(F.col("l").alias("label"), "k").agg(F.sum(-rate * F.col("y") * F.col("v")).alias("value"))


def learning_rate(rate: float, decay: float, clock: Column) -> Column:
    return rate * F.pow(F.lit(decay), clock)


def _sgd(weights: list[list[float]], rate: float):
    """Examples sorted by (worker, id) -> each worker's change of the weights after one pass, example by example."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("worker", pa.int64()), ("label", pa.int32()), ("delta", pa.list_(pa.float64()))])
        start = np.array(weights)
        live, w = None, None

        def made():
            return pa.RecordBatch.from_pylist([{"worker": live, "label": k, "delta": d.tolist()} for k, d in enumerate(w - start)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["worker"] != live:
                    if live is not None:
                        yield made()
                    live, w = r["worker"], start.copy()
                x = np.array(r["x"])
                s = w @ x
                p = np.exp(s - s.max())
                p /= p.sum()
                p[r["label"]] -= 1
                w -= rate * np.outer(p, x)
        if live is not None:
            yield made()

    return run


def sgd_epoch(examples: DataFrame, weights: DataFrame, worker: Column, rate: float) -> DataFrame:
    """One pass of stochastic gradient descent by each worker over its examples in order of id: (worker, label, delta)."""
    start = [list(r.w) for r in sorted(weights.collect(), key=lambda r: r.label)]
    rows = examples.select(worker.cast("long").alias("worker"), "id", "x", "label").repartition("worker").sortWithinPartitions("worker", "id")
    return map_arrow(rows, _sgd(start, rate), "worker long, label int, delta array<double>")


def total_change(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.sum("value").alias("total_change"))
