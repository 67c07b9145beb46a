"""Keyed state as an append-only log: updates (clock, client, thread, tab, rid, cid, value).

A cell is (tab, rid, cid): table, row, column. Updates of a cell add up; a clock closes a batch. All
operators group or join by the cell, so one partitioning serves them, and sums combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["tab", "rid", "cid"]
#: A slack from which a read takes what is at hand, without waiting.
LOCAL_SLACK = 20_000_000


def coalesce_updates(updates: DataFrame, *by: str) -> DataFrame:
    """Sum of the updates of each cell, apart for each value of by."""
    return updates.groupBy(*by, *CELL).agg(F.sum("value").alias("value"))


def coalesce_in_two_levels(updates: DataFrame) -> DataFrame:
    """Threads flush sums to their client's log at a clock's end; the result has no thread."""
    flushed = coalesce_updates(updates, "clock", "client", "thread")
    return coalesce_updates(flushed, "clock", "client")


def running(updates: DataFrame, *by: str) -> DataFrame:
    """Value of each cell after each clock in which it changes."""
    sums = coalesce_updates(updates, "clock", *by)
    w = Window.partitionBy(*by, *CELL).orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("value", F.sum("value").over(w))


def bound(clock: Column, slack: Column) -> Column:
    """The clock up to which a read sees updates: never under the first snapshot, and none in clock 0 or with local slack."""
    return F.when((clock < 1) | (slack >= LOCAL_SLACK), F.lit(-1)).otherwise(F.greatest(clock - 1 - slack, F.lit(0)))


def as_of(state: DataFrame, wanted: DataFrame, at: str, by: tuple = ()) -> DataFrame:
    """wanted with value, the last of state's (by, cell) at a clock up to at; 0 where there is none.

    Both are put in one sequence per cell, and each request takes the last value before it, so no
    request meets more than one row of the log.
    """
    keys = [*by, *CELL]
    extra = [c for c in wanted.columns if c not in keys]
    log = state.select(*keys, F.col("clock").alias("_at"), F.lit(0).alias("_kind"), F.col("value").alias("_v"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra])
    ask = wanted.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_v"), *extra)
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.unionByName(ask).withColumn("value", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(0.0)))
    return seen.where("_kind = 1").select(*wanted.columns, "value")


def cells_of(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests for rows -> for every column of the row in the key set."""
    return requests.join(keys.select(*CELL).distinct(), ["tab", "rid"])


def read(updates: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (client, clock, slack, tab, rid) -> for each column of the row, the value that bounded staleness promises."""
    wanted = cells_of(requests, updates).withColumn("age", bound(F.col("clock"), F.col("slack")))
    return as_of(running(updates), wanted, "age")


def read_my_writes(updates: DataFrame, requests: DataFrame) -> DataFrame:
    """As read, with the client's own updates up to the request's clock."""
    wanted = cells_of(requests, updates).withColumn("age", bound(F.col("clock"), F.col("slack")))
    own = running(updates, "client")
    out = as_of(running(updates), wanted, "age").withColumnRenamed("value", "v_all")
    out = as_of(own, out, "age", ("client",)).withColumnRenamed("value", "v_then")
    out = as_of(own, out, "clock", ("client",)).withColumnRenamed("value", "v_now")
    return out.select(*wanted.columns, (F.col("v_all") + F.col("v_now") - F.col("v_then")).alias("value"))


def vector_clock(progress: DataFrame) -> DataFrame:
    """(worker, clock) reports -> the global clock (the least of the workers' last) and the fast clock."""
    last = progress.groupBy("worker").agg(F.max("clock").alias("clock"))
    return last.agg(F.min("clock").alias("global_clock"), F.max("clock").alias("fast_clock"))


def get_or_create(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The value of every key; zero where the state has none."""
    return keys.join(state, CELL, "left").select(*CELL, F.coalesce("value", F.lit(0.0)).alias("value"))


def missing_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Keys outside a fixed key set."""
    return keys.join(known, CELL, "left_anti")


def _clocks(updates: DataFrame) -> Column:
    """All clocks up to the last as an array."""
    last = updates.agg(F.max("clock")).first()[0]
    return F.sequence(F.lit(0), F.lit(last if last is not None else 0))


def push_reads(updates: DataFrame, subscriptions: DataFrame, clients: int) -> DataFrame:
    """For each clock, the rows pushed to each subscriber: value, age, place in the order of sending.

    Clients are served in rotation, beginning with clock modulo their number.
    """
    wanted = cells_of(subscriptions, updates).withColumn("clock", F.explode(_clocks(updates)))
    out = as_of(running(updates), wanted, "clock")
    return out.withColumn("turn", F.pmod(F.col("client") - F.col("clock"), F.lit(clients)).cast("int"))


def receive(batches: DataFrame) -> DataFrame:
    """Cached rows after batches (client, data_age, cell, value): the value of the greatest age."""
    return batches.groupBy("client", *CELL).agg(F.max("data_age").alias("data_age"), F.max_by("value", "data_age").alias("value"))


def push_updates(updates: DataFrame, servers: int) -> DataFrame:
    """For each clock, client and server: keys with a changed value, and keys that the client has there in all."""
    sums = coalesce_updates(updates, "clock", "client").withColumn("server", F.pmod("rid", F.lit(servers)).cast("int"))
    known = sums.select("client", "server", "tab", "rid").distinct().groupBy("client", "server").agg(F.count("*").alias("n_keys"))
    dirty = sums.groupBy("clock", "client", "server").agg(F.count_distinct("tab", "rid").alias("n_dirty"))
    return dirty.join(known, ["client", "server"]).select("clock", "client", "server", "n_keys", "n_dirty")


def freeable(updates: DataFrame) -> DataFrame:
    """Clocks of the log, and whether all clients have passed them."""
    done = updates.groupBy("client").agg(F.max("clock").alias("c")).agg(F.min("c").alias("global_clock"))
    logs = updates.groupBy("clock").agg(F.count("*").alias("n_updates"))
    return logs.join(F.broadcast(done)).select("clock", "n_updates", (F.col("clock") < F.col("global_clock")).alias("freeable"))  # one row


def progress(reports: DataFrame) -> DataFrame:
    """(clock, client, thread, loss) -> loss of each clock, summed over threads and then clients."""
    return reports.groupBy("clock", "client").agg(F.sum("loss").alias("loss")).groupBy("clock").agg(F.sum("loss").alias("loss"))
