"""The library's readers by name, for queries written in SQL: functions of one text, and table functions for lateral joins and partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from brindle.operators import captures, detect

_SPANS = StructType([StructField("path", StringType()), *[StructField(c, IntegerType()) for c in ("start", "end", "hits")]])


class RegexHits:
    """regex_hits(path, content): a row for each match of each rule, as detect.hits."""

    def eval(self, path: str, content: str) -> Iterator[tuple[int, int, int]]:
        for start, rule, end in detect.matches(path, content or "") if path is not None else ():
            yield rule, start, end


class PlanNodes:
    """plan_nodes(raw): the nodes of a plan in JSON form, as captures.plan_documents."""

    def eval(self, raw: str) -> Iterator[tuple]:
        plan = captures.plan_of(raw) if raw is not None else None
        for k, n in enumerate(captures.json_nodes(plan) if plan is not None else ()):
            yield k, n["depth"], n["node_type"], n["relation"], n["estimated_rows"], n["actual_rows"], n["total_ms"], n["loops"], n["blocks_hit"], n["blocks_read"], n["rows_removed"], n["sort_method"]


class HitSpans:
    """hit_spans(TABLE(hits)): the hits (path, rule, start, end) of each path folded to spans, as detect.spans. The function asks for its partitions and their order
    itself, and holds the hits of one path."""

    def __init__(self) -> None:
        self.path, self.found = None, []

    @staticmethod
    def analyze(hits: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in hits.dataType.fields} if hits.isTable else set()
        if not {"path", "rule", "start", "end"} <= names:
            raise ValueError("hit_spans takes a table with the columns path, rule, start and end")
        return AnalyzeResult(_SPANS, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("start"), OrderingColumn("rule")])

    def eval(self, row: Row) -> None:
        self.path = row["path"]
        self.found.append((row["start"], row["rule"], row["end"]))

    def terminate(self) -> Iterator[tuple[str, int, int, int]]:
        for start, end, rules in detect.spans(self.found):
            yield self.path, start, end, len(rules)


def _mask(path: pd.Series, content: pd.Series, strings: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or c is None else detect.masked(p, c, bool(s)) for p, c, s in zip(path, content, strings)], dtype=object)


def register(spark: SparkSession) -> None:
    """Makes mask_code, regex_hits, plan_nodes and hit_spans known to a session's SQL."""
    spark.udf.register("mask_code", F.pandas_udf(_mask, "string"))
    spark.udtf.register("regex_hits", F.udtf(RegexHits, returnType="rule int, start int, end int"))
    spark.udtf.register("plan_nodes", F.udtf(PlanNodes, returnType="node int, depth int, node_type string, relation string, estimated_rows long, actual_rows double, total_ms double, loops long, blocks_hit long, blocks_read long, rows_removed long, sort_method string"))
    spark.udtf.register("hit_spans", F.udtf(HitSpans))
