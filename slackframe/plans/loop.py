"""Supersteps over the keyed state, and what is reported about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.operators.access import by_thread
from slackframe.operators.log import CELL, coalesce_updates, progress, push_updates
from slackframe.operators.order import numbered
from slackframe.storage import written


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], clocks: int, every: int = 1) -> DataFrame:
    """step(state, clock) again and again; lineage is cut every so many clocks by a written table."""
    for clock in range(clocks):
        state = step(state, clock)
        if (clock + 1) % every == 0 and clock + 1 < clocks:
            state = written(state, "superstep")
    return state


def history(updates: DataFrame, clocks: int) -> DataFrame:
    """State after each clock: what a cell's coalesced updates add up to so far, from its first update on.

    A running sum in one shuffle; a sum stands until the cell's next update.
    """
    sums = coalesce_updates(updates, "clock").where(F.col("clock") < clocks)
    cell = Window.partitionBy(*CELL).orderBy("clock")
    until = F.coalesce(F.lead("clock").over(cell), F.lit(clocks)) - 1
    state = sums.select("clock", *CELL, F.sum("value").over(cell.rowsBetween(Window.unboundedPreceding, 0)).alias("value"), until.alias("until"))
    return state.select(F.explode(F.sequence(F.col("clock").cast("int"), F.col("until").cast("int"))).alias("clock"), *CELL, "value")


def local_rows(updates: DataFrame) -> DataFrame:
    """Private rows: each worker's own sums, which meet no other worker's."""
    return updates.groupBy("client", "thread", *CELL).agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def clock_report(reports: DataFrame) -> DataFrame:
    """(clock, client, thread, ts, loss) -> loss, seconds since the start, and whether all workers reported, for each clock."""
    worker = F.struct("client", "thread")
    start = reports.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"), F.count_distinct(worker).alias("workers")).first()
    seconds = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.lit(start.t0)) / 1e6
    times = reports.groupBy("clock").agg(seconds.alias("seconds"), (F.count_distinct(worker) == F.lit(start.workers)).alias("complete"))
    return progress(reports).join(times, "clock")


def straggler_time(reports: DataFrame) -> DataFrame:
    """Seconds between the first and the last worker that finish a clock."""
    done = reports.groupBy("clock", "client", "thread").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    return done.groupBy("clock").agg(((F.max("t") - F.min("t")) / 1e6).alias("straggler"))


def sampled(ops: DataFrame, every: int = 1000) -> DataFrame:
    """Every so manieth operation of a thread, beginning with the first; those are timed."""
    made = numbered(ops.select("client", "thread", "seq"), ["client", "thread", "seq"], nth=["client", "thread"])
    return made.where(F.col("nth") % every == 0).select("client", "thread", "seq", (F.col("nth") + 1).cast("int").alias("nth"))


def client_stats(ops: DataFrame) -> DataFrame:
    """Counters of each client: sums over threads, and the largest thread cache."""
    per = ops.groupBy("client", "thread").agg(
        F.count_if(F.col("op") == "READ").alias("total_read"), F.count_if(F.col("op") == "WRITE").alias("total_increment"), F.count_distinct("tab", "rid").alias("num_thread_cache")
    )
    return per.groupBy("client").agg(
        F.count("*").alias("num_threads"), F.sum("total_read").alias("total_read"), F.sum("total_increment").alias("total_increment"),
        F.sum("num_thread_cache").alias("num_thread_cache"), F.max("num_thread_cache").alias("num_thread_cache_max"),
    )


def server_stats(updates: DataFrame, servers: int) -> DataFrame:
    """Messages, rows and bytes that clients send to each server."""
    sent = push_updates(updates, servers)
    row = updates.agg(F.count_distinct("cid")).first()[0] * 8
    return sent.groupBy("server").agg(F.count("*").alias("messages"), F.sum("n_dirty").alias("rows"), (F.sum("n_dirty") * F.lit(row)).alias("bytes"))


def stats_json(ops: DataFrame) -> DataFrame:
    """Each client's counters as one JSON object, with an empty object where there is nothing to say."""
    rows = by_thread(ops).groupBy("client").agg(F.count_distinct("tab", "rid").alias("row_count"))
    s = client_stats(ops).join(rows, "client")
    return s.select("client", F.to_json(F.struct("num_threads", "row_count", "num_thread_cache", "num_thread_cache_max", "total_read", "total_increment", F.create_map().cast("map<string,string>").alias("router_stats"))).alias("stats"))
