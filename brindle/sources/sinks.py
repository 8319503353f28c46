"""Reports: JSON, markdown and patches of findings (path, start_line, severity, title, original, proposed, kind)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.report import line_diff

_MARKS = {"ctx": " ", "del": "-", "add": "+"}


def to_json(findings: DataFrame, folder: str) -> None:
    """One JSON object a line, in as many files as there are tasks."""
    findings.write.mode("overwrite").json(folder)


def markdown(findings: DataFrame) -> DataFrame:
    """(path, report): a section for each file, its findings by line."""
    entry = F.concat(F.lit("### "), F.col("title"), F.lit(" ("), F.col("severity"), F.lit(", line "), F.col("start_line").cast("string"), F.lit(")\n\n```\n"), F.col("proposed"), F.lit("\n```\n"))
    rows = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "title", entry.alias("text")))).alias("rows"))
    return rows.select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("report"))


def html(report: str) -> str:
    """A column expression's SQL that escapes a text for HTML."""
    return f"replace(replace(replace({report}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def patches(findings: DataFrame) -> DataFrame:
    """(path, start_line, patch): a unified diff for each finding that keeps its output, by the lines that line_diff tells; a null text is empty; others are left out (left_out counts them)."""

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, line, a, p in zip(b["path"], b["start_line"], b["original"], b["proposed"]):
                rows = line_diff(a or "", p or "")
                before, after = (sum(kind != other for kind, *_ in rows) for other in ("add", "del"))
                texts.append(f"--- a/{path}\n+++ b/{path}\n@@ -{line},{before} +{line},{after} @@\n" + "\n".join(_MARKS[kind] + text for kind, _, _, text in rows) + "\n")
            yield pd.DataFrame({"path": b["path"], "start_line": b["start_line"], "patch": texts})

    return findings.filter("kind = 'equivalent'").select("path", F.col("start_line").cast("long").alias("start_line"), "original", "proposed").mapInPandas(diff, "path string, start_line long, patch string")


def scorecards(lines: DataFrame, folder: str, date: str, whole: bool) -> list[str]:
    """Writes a benchmark's scorecard as JSON below folder, in a folder of its date, and as `latest` too if the run was whole; gives the folders back."""
    targets = [f"{folder.rstrip('/')}/{date}", *([f"{folder.rstrip('/')}/latest"] if whole else [])]
    for t in targets:
        lines.write.mode("overwrite").json(t)
    return targets


def left_out(findings: DataFrame) -> DataFrame:
    """One row: how many findings have a patch, and how many have none because their output may change."""
    keeps = F.col("kind") == "equivalent"
    return findings.agg(F.count(F.when(keeps, 1)).alias("patches"), F.count(F.when(~keeps, 1)).alias("left_out"))


def document(findings: DataFrame, held: DataFrame, coverage: DataFrame) -> DataFrame:
    """(part, key, text): a report in parts, in order of part and key: 0 what was read, 1 findings by severity and kind, 2 a section for each file, 3 what was held back, by reason.

    findings: the columns of markdown; held: reason, path, start_line, title; coverage: one row of files, read and matched. A part is a row of its
    own, so that no task holds the report.
    """
    read = coverage.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("%s of %s files read, %s sites matched", "read", "files", "matched").alias("text"))
    counted = findings.groupBy("severity").pivot("kind", ["equivalent", "behavioural"]).agg(F.count(F.lit(1))).fillna(0)
    summary = counted.select(F.lit(1).alias("part"), F.col("severity").alias("key"), F.format_string("| %s | %d | %d |", "severity", "equivalent", "behavioural").alias("text"))
    files = markdown(findings).select(F.lit(2).alias("part"), F.col("path").alias("key"), F.col("report").alias("text"))
    suppressed = held.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("path", "start_line", "title")).alias("first"))
    back = suppressed.select(F.lit(3).alias("part"), F.col("reason").alias("key"), F.format_string("%s: %d, the first %s (%s:%d)", F.col("reason"), F.col("n"), F.col("first.title"), F.col("first.path"), F.col("first.start_line")).alias("text"))
    return read.unionByName(summary).unionByName(files).unionByName(back)
