"""Confidence and priority of query sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.7
MAX_PER_FILE = 40

# Weights and patterns of the priority score.
BASE, LOOP, HANDLER, MIGRATION, TEST, TERMINAL, UNBOUNDED_FETCH, BATCHED, SCHEMA = 0.4, 0.35, 0.15, -0.4, -0.45, 0.1, 0.1, -0.15, -0.3
MIGRATION_PATH = r"(?i)(^|/)migrations?/|(^|/)seeds?/|(^|/)fixtures?/|(^|/)factories/|(^|/)db/migrate/"
TEST_PATH = r"(?i)(^|/)tests?/|(^|/)spec/|[._-]test\.|[._-]spec\.|_tests?\.py$|Tests?\.(?:java|kt|cs|scala)$"
PER_ROW_TERMINAL = r"\.\s*(?:count|exists)\s*\(|\.\s*aggregate\s*\(|\bCOUNT\s*\(|\.\s*Count\s*\(|\.\s*first\s*\(|\.\s*get\s*\("
UNBOUNDED = r"(?i)\.\s*all\s*\(\s*\)|\bSELECT\s+\*|\.\s*findAll\s*\(|\.\s*ToList\s*\(\s*\)|\.\s*fetchall\s*\("
HAS_LIMIT = r"(?i)\bLIMIT\b|\.\s*limit\s*\(|\[\s*:\s*\d+\s*\]|\.\s*take\s*\(|\bTOP\s+\d+|\.\s*first\s*\("
ALREADY_BATCHED = r"select_related|prefetch_related|\.\s*Include\s*\(|\bPreload\s*\(|joinedload|selectinload|\.\s*includes\s*\(|\.\s*populate\s*\(|\bwith\s*:\s*\[|\bin_bulk\s*\(|__in\b"


def confidence(best: Column, hits: Column) -> Column:
    """A span's confidence: its best rule's, a little more for each further hit, below 1."""
    return F.least(F.lit(0.99), best + F.lit(0.05) * (hits - 1))


def cold_paths(path: Column) -> tuple[Column, Column]:
    """Whether a path is that of a migration, and of a test, as the score takes them."""
    return path.rlike(MIGRATION_PATH), path.rlike(TEST_PATH)


def priority_parts(cold: tuple[Column, Column], excerpt: Column, loop_depth: Column, trigger: Column, access_style: Column) -> list[tuple[str, float, Column]]:
    """(reason, weight, condition) in the order in which they count. cold: cold_paths of the file."""
    migration, test = cold
    return [
        ("in a loop", LOOP, loop_depth > 0),
        ("request handler", HANDLER, trigger == "request-handler"),
        ("migration path", MIGRATION, migration),
        ("test path", TEST, test),
        ("migration only", MIGRATION, (trigger == "migration") & ~migration),
        ("test only", TEST, (trigger == "test") & ~test),
        ("per-row terminal", TERMINAL, excerpt.rlike(PER_ROW_TERMINAL)),
        ("unbounded fetch", UNBOUNDED_FETCH, excerpt.rlike(UNBOUNDED) & ~excerpt.rlike(HAS_LIMIT)),
        ("already batched", BATCHED, excerpt.rlike(ALREADY_BATCHED)),
        ("schema definition", SCHEMA, access_style == "ddl-migration"),
    ]


def priority(path: Column, excerpt: Column, loop_depth: Column, trigger: Column, access_style: Column) -> tuple[Column, Column]:
    """(score in 0 to 1 at four decimals, reasons)."""
    parts = priority_parts(cold_paths(path), excerpt, loop_depth, trigger, access_style)
    score = sum((F.when(c, F.lit(w)).otherwise(0.0) for _, w, c in parts), F.lit(BASE))
    reasons = F.filter(F.array(*[F.when(c, F.lit(f"{w:+.2f} {r}")) for r, w, c in parts]), lambda r: r.isNotNull())
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4))), reasons


def priority_told(cold: tuple[Column, Column], excerpt: Column, loop_depth: Column, trigger: Column, access_style: Column) -> Column:
    """What counts for a site, as array<struct<weight, reason>>: each condition is evaluated once."""
    parts = priority_parts(cold, excerpt, loop_depth, trigger, access_style)
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(w).alias("weight"), F.lit(f"{w:+.2f} {r}").alias("reason"))) for r, w, c in parts]), lambda p: p.isNotNull())


def priority_sum(told: Column) -> Column:
    """The score of priority, from priority_told."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.aggregate(told, F.lit(BASE), lambda total, p: total + p["weight"]), 4)))
