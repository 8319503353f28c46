"""Top-k, retention, budgets and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.running import global_rank, running_total


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def keep_at_least(df: DataFrame, score: str, floor: float, least: int, order: list[Column]) -> DataFrame:
    """Rows at or above the floor, or the best `least` rows if they are more."""
    # The place of a row tells both: whether it is among the best, and whether the floor's number of rows reaches it.
    above = df.agg(F.count(F.when(F.col(score) >= floor, 1)).alias("_above"))
    ranked = global_rank(df, order, "_place")
    return ranked.join(F.broadcast(above), F.lit(True)).filter(F.when(F.col("_above") >= least, F.col(score) >= floor).otherwise(F.col("_place") < least)).drop("_place", "_above")


def newest(df: DataFrame, time: str, now: Column, ttl_seconds: int, keys: list[str], k: int, *tie: str) -> DataFrame:
    """The newest k rows of each key that are younger than the time to live."""
    live = df.filter((F.unix_timestamp(now) - F.unix_timestamp(time) < ttl_seconds) & (F.col(time) <= now))
    return top_k(live, keys, [F.col(time).desc(), *(F.col(t) for t in tie)], k)


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order: a replacing store."""
    return top_k(df, keys, order, 1)


def within_budget(df: DataFrame, order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows taken in order while what was spent before is below the budget; the last one may exceed it. Adds spent_before."""
    return running_total(df, order, cost, "_upto").withColumn("spent_before", F.col("_upto") - F.col(cost)).filter(F.col("spent_before") < budget).drop("_upto")


def fixed_passes(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds pass_no: rows in order, `size` to a pass."""
    return global_rank(df, order, "_place").withColumn("pass_no", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def pack_chunks(df: DataFrame, key: str, order: str, tokens: str, capacity: int, most: int, overhead: int = 60) -> DataFrame:
    """(key, order, chunk): a key's rows in order, packed greedily: a chunk closes when it has `most` rows or the next one would exceed its capacity.

    Packing is a fold over a key's rows: they come sorted to one task, which holds the open chunk's three numbers and nothing else.
    """
    kinds = dict(df.select(key, order).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, n, used = None, 0, 0, 0
        for b in batches:
            out = []
            for k, cost in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                cost += overhead
                if k != now or not n:
                    now, chunk, n, used = k, 0, 0, 0
                elif n >= most or used + cost > capacity:
                    chunk, n, used = chunk + 1, 0, 0
                n, used = n + 1, used + cost
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], [key, order, "chunk"])

    return df.select(key, order, tokens).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, chunk long")


def chunk_capacity(context: Column, overhead: Column, output: Column) -> Column:
    """Tokens of a request that sites may fill: four fifths of what the context leaves, 1,500 at least."""
    return F.greatest(F.lit(1500), F.floor((context - overhead - output) * 0.8)).cast("long")


# Shares that an estimate assumes.
FLAG_RATE, OUTPUT_SHARE = 0.1, 0.35


def estimate(sites: DataFrame, tokens: str, samples: int, output: int, price_in: float, price_out: float) -> DataFrame:
    """(triage_tokens, author_tokens, output_tokens, cost) of analysing sites: each is read `samples` times, and one in ten written up; prices are for a million tokens."""
    total = F.coalesce(F.sum(tokens), F.lit(0))
    told = sites.agg((total * samples).alias("triage_tokens"), F.ceil(total * FLAG_RATE).cast("long").alias("author_tokens"), F.ceil(F.count("*") * FLAG_RATE * output * OUTPUT_SHARE).cast("long").alias("output_tokens"))
    return told.withColumn("cost", F.round(((F.col("triage_tokens") + F.col("author_tokens")) * price_in + F.col("output_tokens") * price_out) / 1e6, 4))


def run_totals(passes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, passes, input_tokens, output_tokens, elapsed_seconds) of passes (keys, started, ended, input_tokens, output_tokens): elapsed from the first start to the
    last end, waits between passes included; passes that have not ended count up to their start."""
    spent = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    end = F.max(F.coalesce("ended", "started"))
    return passes.groupBy(*keys).agg(F.count("*").alias("passes"), *spent, (F.unix_timestamp(end) - F.unix_timestamp(F.min("started"))).alias("elapsed_seconds"))


def shown_with_rest(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, each with how many are left out: the limit is the feature."""
    total = df.agg(F.count("*").alias("_n"))
    return df.orderBy(*order).limit(k).join(F.broadcast(total), F.lit(True)).withColumn("left_out", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def store_summary(entries: DataFrame, time: str, now: Column, ttl_seconds: int, kind: str) -> DataFrame:
    """One row: entries that are alive, the age of the oldest, and their kinds."""
    age = F.unix_timestamp(now) - F.unix_timestamp(time)
    return entries.filter(age.between(0, ttl_seconds - 1)).agg(F.count("*").alias("live"), F.max(age).alias("oldest_seconds"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def budget_left(passes: DataFrame, done: Column, site: str, path: str) -> DataFrame:
    """One row: sites and distinct files that passes not done still hold."""
    return passes.agg(F.count(F.when(~done, 1)).alias("passes_left"), F.count_distinct(F.when(~done, F.col(site))).alias("sites_left"), F.count_distinct(F.when(~done, F.col(path))).alias("files_left"))


def cache_key(*parts: Column) -> Column:
    """A key of parts, in which no part runs into the next."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0001")) for p in parts]), "\u0000"), 256)
