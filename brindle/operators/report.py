"""What leaves the library: differences line by line, fixtures and issues of contradicted findings, summaries and scorecards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Engines that a description of a profile names.
NAMED_ENGINES = 6
# Verdicts that make a finding worth keeping as a fixture.
WORTHY = ("regression", "no-difference")


def line_diff(before: str, after: str) -> list[tuple[str, int | None, int | None, str]]:
    """(kind, left, right, text) of the lines of two texts, by a longest common subsequence: ctx, del or add, with line numbers on either side."""
    a, b = before.rstrip().split("\n"), after.rstrip().split("\n")
    # best[j]: lines that a from i on and b from j on have in common; one row is kept for each i.
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = rows[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("ctx", i + 1, j + 1, a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and rows[i + 1][j] >= rows[i][j + 1]:
            out.append(("del", i + 1, None, a[i]))
            i += 1
        else:
            out.append(("add", None, j + 1, b[j]))
            j += 1
    return out


def diff_rows(pairs: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """(id, at, kind, left_no, right_no, text): the differences of each row's two texts; null is empty."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("left_no", pa.int32()), ("right_no", pa.int32()), ("text", pa.string())]))
    id_kind = dict(pairs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [[dict(zip(("kind", "left_no", "right_no", "text"), r)) for r in line_diff(x or "", y or "")] for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, kind)], [id_col, "d"])

    read = pairs.select(id_col, before, after).mapInArrow(run, f"{id_col} {id_kind}, d array<struct<kind:string,left_no:int,right_no:int,text:string>>")
    return read.select(id_col, F.posexplode("d").alias("at", "d")).select(id_col, "at", "d.*")


def fixtures(judged: DataFrame, repo: Column, commit: Column, at: Column) -> DataFrame:
    """(id, file, content) of findings (id, path, line, category, severity, title, original, proposed, counted, grounding, verdict, because) that measurement contradicted: the numbers, never what was pasted."""
    worthy = judged.filter(F.col("verdict").isin(*WORTHY))
    slug = F.left(F.lower(F.regexp_replace(F.regexp_replace(F.concat_ws("-", repo, F.col("path")), r"[^\w.-]+", "-"), "-+", "-")), F.lit(80))
    finding = F.struct("id", "category", "severity", "title", F.col("path").alias("file"), F.col("line").alias("startLine"), "original", "proposed", F.col("counted").alias("countedFacts"), "grounding")
    body = F.struct(repo.alias("repo"), commit.alias("commitSha"), at.alias("recordedAt"), "verdict", F.col("because").alias("evidence"), finding.alias("finding"))
    return worthy.select("id", F.concat(slug, F.lit("-"), F.col("id").cast("string"), F.lit(".json")).alias("file"), F.to_json(body).alias("content"))


def issues(judged: DataFrame, repo: Column, commit: Column) -> DataFrame:
    """(id, body): the same findings as the text of an issue."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    said = F.when(F.col("verdict") == "regression", "contradicted").otherwise("did not support")
    counted = F.when(F.size("counted") > 0, F.concat(F.lit("**Counted before**\n"), listed(F.col("counted")))).otherwise("_Nothing was counted from the two versions._")
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### A finding that measurement "), said),
        F.concat(F.lit("**Repository:** "), repo, F.lit(" @ "), F.left(commit, F.lit(8)), F.lit("\n**Finding:** "), F.col("title"), F.lit("\n**Place:** "), F.col("path"), F.lit(":"), F.col("line").cast("string")),
        F.concat(F.lit("**Measured**\n"), listed(F.col("because"))),
        counted,
        F.concat(F.lit("**Proposal**\n```\n"), F.col("proposed"), F.lit("\n```")),
    )
    return judged.filter(F.col("verdict").isin(*WORTHY)).select("id", body.alias("body"))


def described_profile(declared: DataFrame) -> DataFrame:
    """One row: the first engines of a profile (engine, authority, first_seen, quote), each with the line that declares it, by authority."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("authority")).alias("k"), "first_seen", "engine", "quote")))
    named = F.transform(F.slice(rows, 1, NAMED_ENGINES), lambda r: F.concat(r["engine"], F.lit(" ("), F.coalesce(r["quote"], F.lit("-")), F.lit(")")))
    # A profile has a row an engine: at most as many as there are engines.
    return declared.agg(F.array_join(named, ", ").alias("described"), F.greatest(F.count("*") - NAMED_ENGINES, F.lit(0)).alias("more"))


def scorecard(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): a line of a benchmark's scorecard for each configuration: its metrics in percent, with their range where runs differ."""
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    told = F.when(F.col("n") == 0, F.lit("–")).when(F.col("low") == F.col("high"), percent(F.col("mean"))).otherwise(F.concat(percent(F.col("mean")), F.lit(" ("), percent(F.col("low")), F.lit("–"), percent(F.col("high")), F.lit(")")))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("metric", F.concat(F.col("metric"), F.lit(" "), told).alias("text")))), lambda x: x["text"])
    return summary.groupBy(*keys).agg(F.array_join(cells, " | ").alias("line"))


def schema_first(files: DataFrame, is_schema: Column, k: int) -> DataFrame:
    """The first k files to read: schema files before others, then by path; the limit is the feature."""
    return files.withColumn("is_schema", is_schema).orderBy(F.col("is_schema").desc(), "path").limit(k)


def observed_names(*tables: DataFrame) -> DataFrame:
    """(tab): the tables that any of several catalogs (tab) names, in lower case and once, without the unknown one."""
    every = tables[0].select(F.lower("tab").alias("tab"))
    for t in tables[1:]:
        every = every.union(t.select(F.lower("tab")))
    return every.filter("tab <> '<unknown>'").distinct()
