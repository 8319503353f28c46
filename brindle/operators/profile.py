"""Which engines a corpus declares, and which of them a query site is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.engines import dialect_of
from brindle.functions.probes import MAX_CHARS, PROBES

# Engines that hold no primary data, and engines that are one dialect.
AUXILIARY = ("redis", "memcached", "elasticsearch", "opensearch", "solr", "etcd")


def declarations(files: DataFrame) -> DataFrame:
    """(path, engine, authority, quote, ord): what the configuration files and manifests among files (path, content) declare, with the line that says so.

    A file's declarations are one array of the patterns that its kind has; files of no kind are filtered by their path, before their content is read.
    """
    kinds = F.array(*[F.when(F.col("path").rlike(f"(?i){p}"), F.lit(k)) for k, (_, p, _) in enumerate(PROBES)])
    read = files.withColumn("_kinds", F.filter(kinds, lambda k: k.isNotNull())).filter((F.size("_kinds") > 0) & (F.length("content") <= MAX_CHARS))

    def said(k: int, n: int) -> Column:
        authority, _, signals = PROBES[k]
        engine, pattern = signals[n]
        line = F.regexp_extract("content", rf"(?im)^.*?(?:{pattern.replace('^', '')}).*$", 0)
        found = F.array_contains("_kinds", k) & F.col("content").rlike(f"(?im){pattern}")
        return F.when(found, F.struct(F.lit(engine).alias("engine"), F.lit(authority).alias("authority"), F.left(F.trim(F.element_at(F.split(line, "\n"), -1)), F.lit(160)).alias("quote"), F.lit(k * 100 + n).alias("ord")))

    every = F.array(*[said(k, n) for k, (_, _, signals) in enumerate(PROBES) for n in range(len(signals))])
    return read.select("path", F.explode(F.filter(every, lambda d: d.isNotNull())).alias("d")).select("path", "d.*")


def engine_profile(declared: DataFrame, engine: str, authority: str, order: str) -> DataFrame:
    """(engine, authority, first_seen, primary, ambiguous): each engine with its highest authority, at the place where it was first declared.

    The primary engine is the first of the highest authority that is no auxiliary store, or, where all of them are, the first; ambiguous if two that are no
    auxiliary stores are of different dialects there.
    """
    best = declared.groupBy(F.col(engine).alias("engine")).agg(F.max(authority).alias("authority"), F.min(order).alias("first_seen"))
    # One row: the highest authority, its first engine, and how many dialects have it.
    top = best.groupBy().agg(F.max("authority").alias("_top"))
    store = ~F.col("engine").isin(*AUXILIARY)
    first = F.coalesce(F.min_by(F.when(store, F.col("engine")), F.when(store, F.col("first_seen"))), F.min_by("engine", "first_seen"))
    at_top = best.join(F.broadcast(top), F.col("authority") == F.col("_top")).groupBy().agg(first.alias("_primary"), F.count_distinct(F.when(store, dialect_of(F.col("engine")))).alias("_n"))
    return best.join(F.broadcast(at_top), F.lit(True), "left").select("engine", "authority", "first_seen", (F.col("engine") == F.col("_primary")).alias("primary"), (F.col("_n") > 1).alias("ambiguous"))


def pick_engine(dialect: Column, by_path: Column, named: Column, declared: Column, primary: Column, ambiguous: Column) -> Column:
    """A dialect in the text, then the path, then a name that the corpus declares, then its primary engine unless that is ambiguous, then the name."""
    return F.coalesce(dialect, by_path, F.when(declared, named), F.when(~ambiguous, primary), named, F.lit("unknown"))


def triage_support(verdicts: DataFrame, site: str, sample: str, flag: Column) -> DataFrame:
    """(site, flagged, samples, share, verdict): in how many samples a site was flagged, out of all that completed; the first sample's verdict stands unless a later one flags it."""
    per = verdicts.groupBy(site, sample).agg(F.max(flag.cast("int")).alias("_f"))
    total = per.groupBy().agg(F.count_distinct(sample).alias("samples"))
    counted = per.groupBy(site).agg(F.sum("_f").alias("flagged"), F.min_by("_f", sample).alias("_first"))
    return counted.join(F.broadcast(total), F.lit(True)).select(site, "flagged", "samples", F.round(F.col("flagged") / F.col("samples"), 4).alias("share"), F.when(F.col("flagged") > 0, "problem").otherwise("clean").alias("verdict"))


def first_answers(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
