"""Captures compared: query logs, plans, and how old they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the comparison.
CHANGE, NOISE, STALE_SECONDS, FUTURE_SECONDS = 0.2, 10, 7 * 86400, 60
MANY = 10


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / before; 0 if both are 0, null if either is unknown, starts from 0, or both are noise."""
    return (
        F.when(before.isNull() | after.isNull(), None)
        .when(before == 0, F.when(after == 0, F.lit(0.0)))
        .when((before < NOISE) & (after < NOISE), None)
        .otherwise((after - before) / before)
    )


def staleness(captured_at: Column, commit: Column, now: Column, head: Column) -> Column:
    """The first reason for which a capture may not hold: unreadable, future, other-commit, old; else fresh."""
    age = F.unix_timestamp(now) - F.unix_timestamp(captured_at)
    return F.when(captured_at.isNull(), "unreadable").when(age < -FUTURE_SECONDS, "future").when(commit != head, "other-commit").when(age > STALE_SECONDS, "old").otherwise("fresh")


def log_verdict(original: Column, proposed: Column) -> Column:
    """By numbers of statements: more is a regression, as many no difference, fewer confirmed; a missing side is no evidence."""
    return F.when(original.isNull() | proposed.isNull(), "insufficient-evidence").when(proposed > original, "regression").when(proposed == original, "no-difference").otherwise("confirmed")


def plan_verdict(changes: list[Column]) -> Column:
    """Of relative changes, where less is better: any worse one makes a regression, else any better one confirms."""
    worse = F.exists(F.array(*changes), lambda c: c > CHANGE)
    better = F.exists(F.array(*changes), lambda c: c < -CHANGE)
    known = F.exists(F.array(*changes), lambda c: c.isNotNull())
    return F.when(~known, "insufficient-evidence").when(F.coalesce(worse, F.lit(False)), "regression").when(F.coalesce(better, F.lit(False)), "confirmed").otherwise("no-difference")


def sides(captures: DataFrame, key: str, side: str, original: str, proposed: str, measures: dict[str, Column]) -> DataFrame:
    """One row per key with every measure of both sides (name_a, name_b), in one aggregation."""
    of = lambda m, s: F.sum(F.when(F.col(side) == s, m))
    columns = [of(m, s).alias(f"{n}_{x}") for n, m in measures.items() for s, x in ((original, "a"), (proposed, "b"))]
    return captures.filter(F.col(side).isin(original, proposed)).groupBy(key).agg(*columns)


def shape_counts(log: DataFrame, keys: list[str], shape: str, order: str) -> DataFrame:
    """(keys, shape, n, first_seen, repeated): how often a capture runs each shape; repeated above MANY."""
    return log.groupBy(*keys, shape).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).withColumn("repeated", F.col("n") > MANY)


def plan_totals(nodes: DataFrame) -> DataFrame:
    """Totals of plan trees held as rows (capture_id, node_id, node_type, relation, rows_removed, blocks_read, blocks_hit, sort_method)."""
    return nodes.groupBy("capture_id").agg(
        F.count("*").alias("nodes"),
        F.sum("blocks_read").alias("blocks_read"),
        F.sum("blocks_hit").alias("blocks_hit"),
        F.sum("rows_removed").alias("rows_removed"),
        F.array_sort(F.collect_set("node_type")).alias("node_types"),
        F.array_sort(F.collect_set(F.when(F.col("node_type") == "Seq Scan", F.col("relation")))).alias("seq_scans"),
        F.bool_or(F.col("blocks_read").isNotNull() | F.col("blocks_hit").isNotNull()).alias("buffers"),
    )
