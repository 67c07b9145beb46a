"""Access logs: what threads read and write, and where rows should be placed and cached.

ops (client, thread, seq, op, tab, rid, slack, vclock); op is READ, WRITE or CLOCK, and vclock is
the virtual clock that an access belongs to. CLOCK rows carry no key and are left out of summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackframe.operators.order import numbered

KEY = ["tab", "rid"]


def accesses(ops: DataFrame) -> DataFrame:
    return ops.where("op in ('READ', 'WRITE')")


def by_thread(ops: DataFrame) -> DataFrame:
    """Which keys a thread reads and writes in each virtual clock."""
    return accesses(ops).groupBy("client", "thread", *KEY, "vclock").agg(F.bool_or(F.col("op") == "READ").alias("reads"), F.bool_or(F.col("op") == "WRITE").alias("writes"))


def by_client(ops: DataFrame) -> DataFrame:
    """The same over all threads of a client, with the number of threads that access the key at all."""
    flags = by_thread(ops)
    threads = flags.groupBy("client", *KEY).agg(F.count_distinct("thread").alias("n_threads"))
    merged = flags.groupBy("client", *KEY, "vclock").agg(F.bool_or("reads").alias("reads"), F.bool_or("writes").alias("writes"))
    return merged.join(threads, ["client", *KEY])


def counts(ops: DataFrame) -> DataFrame:
    """Clocks, not accesses, in which a client reads and writes a key."""
    return by_client(ops).groupBy("client", *KEY).agg(F.sum(F.col("reads").cast("int")).alias("num_read"), F.sum(F.col("writes").cast("int")).alias("num_write"))


def home(rid: Column, machines: int, channels: int) -> tuple[Column, Column]:
    """Machine and channel of a row by its number."""
    return F.floor(F.pmod(rid, F.lit(machines * channels)) / channels).cast("int"), F.pmod(rid, F.lit(channels)).cast("int")


def hash_placement(keys: DataFrame, machines: int, channels: int) -> DataFrame:
    machine, channel = home(F.col("rid"), machines, channels)
    return keys.select(*KEY, machine.alias("machine"), channel.alias("channel"))


def most_frequent(ops: DataFrame) -> DataFrame:
    """For each key the client that accesses it in most clocks; ties go to the lower client."""
    c = counts(ops).withColumn("freq", F.col("num_read") + F.col("num_write"))
    return c.groupBy(*KEY).agg(F.max("freq").alias("freq"), F.min_by("client", F.struct(-F.col("freq"), F.col("client"))).alias("machine"))


def locality_placement(ops: DataFrame, machines: int, channels: int) -> DataFrame:
    """Each key at the client that accesses it most; ties go to the one with less load so far.

    Keys of one metadata server (home machine and channel) are placed in order of (tab, rid), which
    is a sequence by definition; servers run in parallel, and a task holds one load per machine.
    """
    machine, channel = home(F.col("rid"), machines, channels)
    c = counts(ops).withColumn("freq", F.col("num_read") + F.col("num_write")).withColumn("server", machine).withColumn("channel", channel)
    rows = c.groupBy("server", "channel", *KEY).agg(F.sort_array(F.collect_list(F.struct("client", "freq"))).alias("asked"))  # one entry for each client
    dealt = rows.repartition("server", "channel").sortWithinPartitions("server", "channel", *KEY)
    from slackframe.storage import map_arrow

    return map_arrow(dealt, place, "tab long, rid long, channel int, machine int, freq long")


def place(batches):
    """Rows (server, channel, tab, rid, asked) in order -> placement."""
    import pyarrow as pa

    group, load = None, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if group != (r["server"], r["channel"]):
                group, load = (r["server"], r["channel"]), {}
            best, most = 0, 0
            for x in r["asked"]:
                freq = x["freq"]
                if freq > most or (freq == most and load.get(x["client"], 0) < load.get(best, 0)):
                    best, most = x["client"], freq
            load[best] = load.get(best, 0) + most
            out.append({"tab": r["tab"], "rid": r["rid"], "channel": r["channel"], "machine": best, "freq": most})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("tab", pa.int64()), ("rid", pa.int64()), ("channel", pa.int32()), ("machine", pa.int32()), ("freq", pa.int64())]))


def find_rows(asked: DataFrame, placement: DataFrame) -> DataFrame:
    return asked.join(placement, KEY)


def dense_ids(keys: DataFrame) -> DataFrame:
    """(tab, rid, machine, channel) -> place of each key in its channel's cache, and in its server's part of the log."""
    made = numbered(keys, KEY, cache_id=["channel"], oplog_id=["channel", "machine"])
    return made.withColumns({c: F.col(c).cast("int") for c in ("cache_id", "oplog_id")})


def row_counts(placement: DataFrame, machine: int) -> DataFrame:
    return placement.agg(F.count("*").alias("row_count"), F.count_if(F.col("machine") == machine).alias("row_count_local"))


def thread_cached(ops: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Keys worth a thread's own cache: its share of the thread's accesses times the threads that access it."""
    a = accesses(ops)
    per = a.groupBy("client", "thread", *KEY).agg(F.count("*").alias("n"))
    total = per.groupBy("client", "thread").agg(F.sum("n").alias("total"))  # a row for each thread
    threads = a.groupBy("client", *KEY).agg(F.count_distinct("thread").alias("n_threads"))
    scored = per.join(total, ["client", "thread"]).join(threads, ["client", *KEY])
    scored = scored.withColumn("score", F.col("n") / F.col("total") * F.col("n_threads"))
    return scored.where(F.col("score") >= threshold).select("client", "thread", *KEY, "n", "n_threads", "score")


def virtual_clocks(ops: DataFrame, supported: int = 1) -> DataFrame:
    """Number of virtual clocks, and whether it is one that a static plan needs."""
    return ops.agg(F.count_distinct("vclock").alias("n_vi_clocks")).withColumn("supported", F.col("n_vi_clocks") == supported)


def worker_of(machine: Column, thread: Column, machines: int) -> Column:
    return machine + thread * machines


def balanced_split(n: Column, workers: int, worker: Column) -> tuple[Column, Column]:
    """Offset and size of a worker's contiguous part of n items."""
    div, rest = F.floor(n / workers), F.pmod(n, F.lit(workers))
    return div * worker + F.least(worker, rest), div + (worker < rest).cast("long")
