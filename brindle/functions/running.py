"""Ranks and running totals over a global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut


def range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted over range partitions and cut, with _part (partition) and _at (place in it).

    The order should end in a column that tells rows apart, so that no key holds a partition alone.
    """
    sorted_rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(sorted_rows, "sorted")
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all rows up to and with this one. One row per partition meets in a window, not all rows."""
    rows = range_sorted(df, *order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # starts has one row per range partition of the sort above.
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.sum(value).over(within)).drop("_part", "_at", "_start")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds out: the row's place from 0 in the global order."""
    rows = range_sorted(df, *order)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
