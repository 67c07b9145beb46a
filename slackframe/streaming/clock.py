"""The update log as a stream (an extension): each micro-batch closes a clock.

Updates arrive as rows (client, thread, tab, rid, cid, value). A batch is coalesced and appended to
a log table under its number, so a batch that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slackframe.operators.log import CELL, coalesce_updates


def close_clocks(stream: DataFrame, log_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the stream's coalesced updates to log_path/clock=<batch>."""

    def close(batch: DataFrame, clock: int) -> None:
        coalesce_updates(batch, "client").write.mode("overwrite").parquet(f"{log_path}/clock={clock}")

    writer = stream.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def state_at(spark, log_path: str, clock: int) -> DataFrame:
    """Values of all cells after a clock; later clocks' folders aren't read."""
    log = spark.read.parquet(log_path).where(F.col("clock") <= clock)
    return log.groupBy(*CELL).agg(F.sum("value").alias("value"))


def windowed(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Updates with an event time ts, summed by cell and window; late ones within delay still count."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), *CELL).agg(F.sum("value").alias("value"))
