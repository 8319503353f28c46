"""Hits merged to spans, runs of lines, and frames around matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters within which two hits are one span, if neither or if one is a fragment.
WINDOW, FRAGMENT_WINDOW = 120, 400


def merge_fixed(hits: DataFrame, keys: list[str], start: str, end: str, gap: int | Column) -> DataFrame:
    """(keys, first, last, hits): hits of a key whose start is at most gap after the largest end so far. One sort per key, no fold."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    grouped = hits.withColumn("_new", new).withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_span").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("hits")).drop("_span")


def folded_spans(hits: DataFrame, key: str, gap: int = WINDOW, fragment_gap: int = FRAGMENT_WINDOW) -> DataFrame:
    """(key, first, last, fragment, hits): spans of rows (key, start, ord, end, fragment).

    The wider gap holds if this hit or any hit already in the span is a fragment, so the gap depends on the span so far: a
    fold, not a lag. A key's hits come sorted to one task, which holds the open span and nothing else, however many there are.
    """
    kind = dict(hits.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # key, first, last, fragment, hits of the open span
        for b in batches:
            out = []
            for k, start, end, fragment in zip(*(b.column(c).to_pylist() for c in range(4))):
                if now is not None and k == now[0] and start <= now[2] + (fragment_gap if fragment or now[3] else gap):
                    now = (k, now[1], max(now[2], end), now[3] or fragment, now[4] + 1)
                else:
                    if now is not None:
                        out.append(now)
                    now = (k, start, end, fragment, 1)
            yield _span_rows(out, key, b.schema.field(0).type)
        if now is not None:
            yield _span_rows([now], key, b.schema.field(0).type)

    ordered = hits.repartition(key).sortWithinPartitions(key, "start", "ord").select(key, F.col("start").cast("long"), F.col("end").cast("long"), "fragment")
    return ordered.mapInArrow(run, f"{key} {kind}, first long, last long, fragment boolean, hits long")


def _span_rows(rows: list[tuple], name: str, key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], [name, "first", "last", "fragment", "hits"])


def line_runs(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, first_line, last_line, lines): contiguous runs of distinct lines."""
    distinct = df.select(*keys, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return distinct.withColumn("_run", island).groupBy(*keys, "_run").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count("*").alias("lines")).drop("_run")


def in_frame(df: DataFrame, keys: list[str], order: list[str], match: Column, before: int, after: int) -> DataFrame:
    """Rows from `before` rows before a match to `after` rows behind it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-after, before)
    return df.withColumn("_near", F.max(match.cast("int")).over(w)).filter("_near = 1").drop("_near")
