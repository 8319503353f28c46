"""Joins whose keys may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in HOT_SHARE of all rows, so that there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 1000
#: Parts a hot key's rows are dealt in.
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """The keys of a table (keys, n: rows of each key) that have more than one in `share` of all rows: fewer than `share` of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) * share > total).select(*keys)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with a table of one row per key ("inner", "left" or "left_semi").

    hot: the hot keys among rows, of hot_keys. Their rows are dealt in `salts` parts by the columns `spread`, which tell rows of a key
    apart, and by the partition they come from, and each part meets a copy of the key's row in the table; fewer than HOT_SHARE keys are broadcast, and HOT_SHARE * salts
    rows are copied, at any size. Null keys match nothing.
    """
    flags = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    dealt = rows.join(flags, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit("salt"), F.spark_partition_id(), *spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = table.join(flags, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
