"""Update functions of the keyed state, as windows over the coalesced log.

Input: sums (clock, client, cell, value), at most one row per clock, client and cell; the order is
(clock, client). A client's first clock is plain addition, whatever the function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.operators.log import CELL, coalesce_updates


def _in_order():
    return Window.partitionBy(*CELL).orderBy("clock", "client")


def _so_far():
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


def staged(updates: DataFrame) -> DataFrame:
    """Updates -> coalesced sums with whether they belong to their client's first clock."""
    first = updates.groupBy("client").agg(F.min("clock").alias("first_clock"))  # one row for each client
    return coalesce_updates(updates, "clock", "client").join(first, "client").withColumn("initial", F.col("clock") == F.col("first_clock")).drop("first_clock")


def _total(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*CELL).agg(F.sum("step").alias("value"))


def add(sums: DataFrame, rate: float = 1.0) -> DataFrame:
    return _total(sums.withColumn("step", F.col("value")))


def stepsize(sums: DataFrame, rate: float) -> DataFrame:
    return _total(sums.withColumn("step", F.when(F.col("initial"), F.col("value")).otherwise(rate * F.col("value"))))


def adagrad(sums: DataFrame, rate: float) -> DataFrame:
    g = F.when(F.col("initial"), 0.0).otherwise(F.col("value"))
    steps = sums.withColumn("g", g).withColumn("acc", F.sum(F.col("g") * F.col("g")).over(_so_far()))
    return _total(steps.withColumn("step", F.when(F.col("initial"), F.col("value")).otherwise(rate * F.col("g") / F.sqrt(F.col("acc") + 1))))


def adarevision(sums: DataFrame, rate: float) -> DataFrame:
    """AdaGrad with the step taken back and redone for gradients that arrived in the same clock."""
    within = Window.partitionBy(*CELL, "clock").orderBy("client").rowsBetween(Window.unboundedPreceding, -1)
    g = F.when(F.col("initial"), 0.0).otherwise(F.col("value"))
    steps = sums.withColumn("g", g).withColumn("back", F.coalesce(F.sum("g").over(within), F.lit(0.0)))
    steps = steps.withColumn("z", F.sum(F.col("g") * F.col("g") + 2 * F.col("g") * F.col("back")).over(_so_far()))
    steps = steps.withColumn("most", F.greatest(F.lit(0.0), F.max("z").over(_so_far())))
    steps = steps.withColumn("before", F.coalesce(F.lag("most").over(_in_order()), F.lit(0.0)))
    eta, old = rate / F.sqrt(F.col("most") + 1), rate / F.sqrt(F.col("before") + 1)
    move = eta * F.col("g") + (eta - old) * F.col("back")
    return _total(steps.withColumn("step", F.when(F.col("initial"), F.col("value")).otherwise(move)))


#: Functions by name; register adds one.
FUNCTIONS: dict[str, Callable[[DataFrame, float], DataFrame]] = {"add": add, "stepsize": stepsize, "adagrad": adagrad, "adarevision": adarevision}


def register(name: str, function: Callable[[DataFrame, float], DataFrame]) -> None:
    """A function of (sums with initial, rate) that returns (cell, value)."""
    FUNCTIONS[name] = function


def apply(updates: DataFrame, function: str, rate: float = 1.0) -> DataFrame:
    """State after all updates under a function of the registry."""
    return FUNCTIONS[function](staged(updates), rate)
