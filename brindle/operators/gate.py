"""Which findings are published, why others are held back, and how severe they are: ordered cascades over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons in their order, severities by rank, and wordings of counted facts.
REASONS = ("no-op", "invented-symbol", "not-data-access", "wrong-direction", "unsupported-assumption", "cold-path", "unsupported-speculation", "immaterial")
SEVERITIES = ("critical", "high", "medium", "low", "info")
ROUND_TRIPS = ("round-trip", "n-plus-one", "batching")
NARROWING = r"(?i)fewer column|named column"
SUBSTANTIVE = r"(?i)out of the loop|database call|per-row lookup|caps the result|eager loading|unbounded"
LEAST_SAMPLES, SUPPORT = 3, 0.5


def suppression(f: dict[str, Column]) -> Column:
    """The first reason that holds, null for a published finding.

    f: original, proposed, invented, data_access, category, count_a, count_b, leaves_loop, contradicted, trigger, kind, schema_object,
    questionable, counted (array), samples, flagged, per_iteration.
    """
    collapse = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    n = F.size(f["counted"])
    weak = (f["samples"] >= LEAST_SAMPLES) & (f["flagged"] / f["samples"] < SUPPORT)
    narrow = (n > 0) & ~F.exists(f["counted"], lambda c: c.rlike(SUBSTANTIVE)) & F.forall(f["counted"], lambda c: c.rlike(NARROWING))
    cases = [
        (F.trim(f["proposed"]) == "", "no-op"),
        (collapse(f["original"]) == collapse(f["proposed"]), "no-op"),
        (f["invented"], "invented-symbol"),
        (~f["data_access"], "not-data-access"),
        # Nothing counted on either side is no comparison.
        (f["category"].isin(*ROUND_TRIPS) & ((f["count_a"] > 0) | (f["count_b"] > 0)) & (f["count_b"] >= f["count_a"]) & ~f["leaves_loop"], "wrong-direction"),
        (f["contradicted"], "unsupported-assumption"),
        (f["trigger"].isin("migration", "test") & (f["kind"] == "equivalent") & ~f["schema_object"], "cold-path"),
        (f["questionable"] & (n == 0) & weak, "unsupported-speculation"),
        (narrow & ~f["per_iteration"] & ~f["schema_object"], "immaterial"),
    ]
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for test, reason in cases[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), reason)
    return out


def severity(f: dict[str, Column]) -> Column:
    """Severity from evidence. f: trigger, schema_object, per_iteration, counted_n, category."""
    some = f["counted_n"] > 0
    return (
        F.when(~f["schema_object"] & f["trigger"].isin("migration", "test"), "info")
        .when(f["schema_object"] & (f["trigger"] == "test"), "info")
        .when(f["per_iteration"] & (f["trigger"] == "request-handler"), F.when(some, "high").otherwise("medium"))
        .when(f["per_iteration"], F.when(some, "medium").otherwise("low"))
        .when(f["category"] == "n-plus-one", "low")
        .when(f["schema_object"], F.when(some, "medium").otherwise("low"))
        .when(~some, "low")
        .otherwise("medium")
    )


def capped(level: Column, needs_verification: Column, samples: Column, flagged: Column, counted_n: Column) -> Column:
    """An unconfirmed citation caps at low; then weak support with nothing counted takes one step from high and medium."""
    cited = F.when(needs_verification & level.isin("critical", "high", "medium"), "low").otherwise(level)
    weak = (samples >= LEAST_SAMPLES) & (flagged / samples < SUPPORT) & (counted_n == 0)
    return F.when(weak & (cited == "high"), "medium").when(weak & (cited == "medium"), "low").otherwise(cited)


def reason_counts(judged: DataFrame, reason: str) -> DataFrame:
    """(reason, n) of every reason, 0 where none was held back for it."""
    spark = judged.sparkSession
    every = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    return every.join(judged.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n")), "reason", "left").fillna(0, ["n"])


def severity_matrix(judged: DataFrame, level: str, kind: str, kinds: list[str]) -> DataFrame:
    """Findings by severity and kind, zero-filled."""
    return judged.groupBy(F.col(level).alias("severity")).pivot(kind, kinds).agg(F.count(F.lit(1))).fillna(0)


def unknown_names(accessed: DataFrame, vocabulary: DataFrame, name: str, files: DataFrame, least_files: int) -> DataFrame:
    """Accessed names that no file of the corpus has; none at all where files are too few to be a vocabulary."""
    found = accessed.join(vocabulary.select(name).distinct(), name, "left_anti")
    # One row: how many files there are.
    enough = files.agg(F.count("*").alias("_files")).filter(F.col("_files") >= least_files)
    return found.join(F.broadcast(enough), F.lit(True), "left_semi")


def headline(judged: DataFrame, reason: str) -> DataFrame:
    """One row: how many findings are published, and how many are held back for which reasons, in the order of the reasons."""
    counts = judged.agg(F.count(F.when(F.col(reason).isNull(), 1)).alias("published"), F.count(reason).alias("held"), *[F.count(F.when(F.col(reason) == r, 1)).alias(f"_{k}") for k, r in enumerate(REASONS)])
    parts = F.filter(F.array(*[F.when(F.col(f"_{k}") > 0, F.concat(F.col(f"_{k}").cast("string"), F.lit(f" {r}"))) for k, r in enumerate(REASONS)]), lambda x: x.isNotNull())
    none = (F.col("published") == 0) & (F.col("held") == 0)
    text = F.when(none, "No findings").when(F.col("held") == 0, F.format_string("%d published, none held back", "published")).otherwise(F.concat(F.format_string("%d published, %d held back: ", "published", "held"), F.array_join(parts, ", ")))
    return counts.select("published", "held", text.alias("headline"))
