"""Places of rows in an order of any columns, by one range shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch


def placed(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows``, written in ``order`` (nulls first), with their ``place`` from 0.

    A row's place is the count of the earlier partitions and its own in its partition, so neither a window nor a task
    holds more than a partition; equal rows may swap places, but only before they are written.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    laid = scratch.table(laid, name)
    part = F.shiftright("_n", 33)  # the upper bits of such an id are the partition, the lower ones the row in it
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_start")))  # a row for each partition
    place = F.col("_start") + F.col("_n").bitwiseAND((1 << 33) - 1)
    return laid.withColumn("_part", part).join(starts, "_part").withColumn("place", place).drop("_part", "_start", "_n")
