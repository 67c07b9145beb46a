"""Matrix factorisation: ratings (i, j, x), factors L by row and R by column.

In an epoch R is frozen; each row's factors move with every rating of the row in order, by AdaGrad,
and the gradients of R are pushed as updates of the keyed state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.functions.special import dot, normal, unit
from slackframe.storage import map_arrow

LAMBDA = 0.01


def fixed_factors(ids: DataFrame, key: str, rank: int, a: int, b: int) -> DataFrame:
    """(key, vec) with small factors that depend on the id alone."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: ((F.col(key) * a + k * b + 7) % 101 - 50) / 500)
    return ids.select(key, vec.alias("vec"))


def random_factors(ids: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """(key, vec) with entries from N(0, 0.1), drawn from the id and the seed, so that reruns and retried tasks agree."""
    draw = lambda k: normal(unit(F.col(key), F.lit(seed + 2 * k)), unit(F.col(key), F.lit(seed + 2 * k + 1)))
    return ids.select(key, F.array(*[draw(k) * 0.1 for k in range(rank)]).alias("vec"))


def shapes(ratings: DataFrame) -> DataFrame:
    """total, n rows, n columns, and the regularisers lambda / (total / n) and lambda / (total / m)."""
    s = ratings.agg(F.count("*").alias("total"), F.count_distinct("i").alias("n"), F.count_distinct("j").alias("m"))
    return s.select("total", "n", "m", (LAMBDA / (F.col("total") / F.col("n"))).alias("lambda_l"), (LAMBDA / (F.col("total") / F.col("m"))).alias("lambda_r"))


def with_factors(ratings: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return ratings.join(left.withColumnRenamed("vec", "l"), "i").join(right.withColumnRenamed("vec", "r"), "j")


def predicted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", dot(F.col("l"), F.col("r"))).withColumn("loss", (F.col("x") - F.col("p")) * (F.col("x") - F.col("p")))


def gradients(rows: DataFrame, lambda_l: float, lambda_r: float) -> DataFrame:
    """Negative gradients of each rating for its row and its column."""
    diff = F.col("p") - F.col("x")
    move = lambda of, with_, lam: F.zip_with(of, with_, lambda u, v: -(2 * diff * v + lam * u))
    return rows.select("i", "j", move("l", "r", lambda_l).alias("move_l"), move("r", "l", lambda_r).alias("move_r"))


def column_updates(moves: DataFrame) -> DataFrame:
    """Sum of the moves of each column factor, as cells (j, k, value)."""
    return moves.select("j", F.posexplode("move_r").alias("k", "v")).groupBy("j", "k").agg(F.sum("v").alias("value"))


def _fold(rank: int, rate: float, lambda_l: float, lambda_r: float, eps: float):
    """Rows sorted by (i, j) -> one row for each rating with the column's move, and one per i with its last factors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("vec", pa.list_(pa.float64())), ("loss", pa.float64())])
        live, vec, acc = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["i"] != live:
                    if live is not None:
                        out.append({"i": live, "j": None, "vec": vec.tolist(), "loss": None})
                    live, vec, acc = r["i"], np.array(r["l"]), np.zeros(rank)
                other = np.array(r["r"])
                diff = float(vec @ other) - r["x"]
                for_l, for_r = -(2 * diff * other + lambda_l * vec), -(2 * diff * vec + lambda_r * other)
                out.append({"i": live, "j": r["j"], "vec": for_r.tolist(), "loss": diff * diff})
                acc += for_l * for_l
                vec = vec + np.divide(rate * for_l, np.sqrt(acc + eps), out=np.zeros(rank), where=acc + eps > 0)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if live is not None:
            yield pa.RecordBatch.from_pylist([{"i": live, "j": None, "vec": vec.tolist(), "loss": None}], schema=schema)

    return run


def epoch(ratings: DataFrame, left: DataFrame, right: DataFrame, rank: int, rate: float, lambda_l: float, lambda_r: float, eps: float = 0.0) -> DataFrame:
    """One epoch: (i, j, vec, loss), where j is null for the new factors of row i, else vec is the move of column j.

    Ratings of a row are taken in order of j. A task streams its rows in order and holds one row's
    factors. Where an accumulated square is 0 (and eps too) the step is 0.
    """
    rows = with_factors(ratings, left, right).select(F.col("i").cast("long"), F.col("j").cast("long"), "x", "l", "r").repartition("i").sortWithinPartitions("i", "j")
    return map_arrow(rows, _fold(rank, rate, lambda_l, lambda_r, eps), "i long, j long, vec array<double>, loss double")


def accesses(ratings: DataFrame, client: Column, thread: Column) -> DataFrame:
    """A read and a write of the column's row for each rating; local accesses of the row's own factors aren't shared."""
    op = F.explode(F.array(F.lit("READ"), F.lit("WRITE")))
    return ratings.select(client.alias("client"), thread.alias("thread"), op.alias("op"), F.lit(0).cast("long").alias("tab"), F.col("j").alias("rid"), F.lit(0).alias("slack"), F.lit(0).alias("vclock"))
