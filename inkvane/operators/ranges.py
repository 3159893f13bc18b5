"""Running sums over a whole table by range partitions: no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of a column over all rows before each in the given order, 0 for the first.

    Rows that are equal in `order` count in any order. The table is partitioned
    by range and written to the checkpoint folder; a row per partition is
    broadcast.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(F.broadcast(sums), "_part")
    return rows.withColumn(out, F.col(out) + F.col("_ahead")).drop("_part", "_ahead")


def ranked(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with each row's place in the given order, from 0."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")
