"""Running numbers over a whole table, without a task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackframe.storage import written


def numbered(rows: DataFrame, order: list, **names: list[str]) -> DataFrame:
    """Rows with a number from 0 in the order given (columns or names) for each name=groups: within groups of equal values there, or over all for [].

    Rows are dealt by ranges of the order and numbered within each range; ranges are offset by
    running counts, of which there is one for each range and group.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(rows.repartitionByRange(*by).withColumn("__sf_part", F.spark_partition_id()), "dealt")
    for name, groups in names.items():
        sizes = dealt.groupBy("__sf_part", *groups).agg(F.count("*").alias("__sf_n"))
        before = Window.partitionBy(*groups).orderBy("__sf_part").rowsBetween(Window.unboundedPreceding, -1)
        base = sizes.select("__sf_part", *groups, F.coalesce(F.sum("__sf_n").over(before), F.lit(0)).alias("__sf_base"))
        here = F.row_number().over(Window.partitionBy("__sf_part", *groups).orderBy(*by))
        dealt = dealt.join(base, ["__sf_part", *groups]).withColumn(name, F.col("__sf_base") + here - 1).drop("__sf_base")
    return dealt.drop("__sf_part").select(*rows.columns, *names)
