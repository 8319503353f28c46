"""Quality of findings against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """At four decimals; null over nothing, which is not zero."""
    return F.when(whole > 0, F.round(part / whole, 4))


def summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, low, high, n) over runs; runs without a value don't count."""
    long = runs.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


def gates(worst: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, value, bound, passed): each metric's worst run against its bound, from below ('least') or above ('most')."""
    value = F.when(F.col("side") == "least", F.col("low")).otherwise(F.col("high"))
    ok = F.when(F.col("side") == "least", value >= F.col("bound")).otherwise(value <= F.col("bound"))
    return bounds.join(worst, "metric", "left").select("metric", value.alias("value"), "bound", F.coalesce(ok, F.lit(False)).alias("passed"))
