"""Four questions that need no model, each in one call: where are the queries, is a rewrite the same, how is it measured, what does the schema say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.calls import call_deltas, with_call_shapes
from brindle.functions.engines import family_of
from brindle.functions.statements import equivalence, with_sql_shapes
from brindle.operators import ddl, detect, matching, profile, recipes
from brindle.session import cut

#: Sites that an answer shows, and characters of each one's excerpt.
SHOWN, EXCERPT = 200, 300
#: What declarations never tell.
CANNOT_KNOW = ("row counts", "selectivity", "which indexes exist in production", "index bloat")


def detect_queries(files: DataFrame, shown: int = SHOWN) -> tuple[DataFrame, DataFrame]:
    """(sites, summary) of files (path, content).

    sites: path, start_line, engine, confidence, priority, trigger, loop_depth, excerpt, the first `shown` by priority, ties by place. summary: one row of files, candidates, more
    (sites not shown), primary, ambiguous, and declared, the engines that configurations and manifests name, each with where and in which words.
    """
    declared = cut(profile.declarations(files), "declared")
    engines = cut(profile.engine_profile(declared, "engine", "authority", "ord"), "profile")
    found = cut(detect.candidates(files, engines), "candidates")
    rows = found.select("path", "start_line", "engine", F.round("confidence", 3).alias("confidence"), F.round("priority", 3).alias("priority"), "trigger", "loop_depth", F.left("excerpt", F.lit(EXCERPT)).alias("excerpt"))
    sites = rows.orderBy(F.col("priority").desc(), "path", "start_line").limit(shown)
    named = engines.agg(F.max(F.when(F.col("primary"), F.col("engine"))).alias("primary"), F.coalesce(F.bool_or("ambiguous"), F.lit(False)).alias("ambiguous"))
    # An engine is declared once here: by its highest authority, at the first such place.
    quotes = declared.groupBy("engine").agg(F.min_by(F.struct("path", "quote"), F.struct(-F.col("authority"), "path", "ord")).alias("at")).agg(F.array_sort(F.collect_list(F.struct("engine", "at.path", "at.quote"))).alias("declared"))
    counts = files.agg(F.count("*").alias("files")).join(F.broadcast(found.agg(F.count("*").alias("candidates"), F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))), F.lit(True))
    return sites, counts.join(F.broadcast(named), F.lit(True)).join(F.broadcast(quotes), F.lit(True))


def check_equivalence(pairs: DataFrame, kind: str = "auto") -> DataFrame:
    """(id, reader, status, hard, soft, undecided) of pairs (id, original, proposed): read as SQL, as calls of a library (kind "orm"), or, with "auto", as SQL
    unless that is unverifiable and the calls are not. Null texts are unverifiable."""
    rows = with_call_shapes(with_sql_shapes(pairs, _a=F.col("original"), _b=F.col("proposed")), F.lit(0), _oa=F.col("original"), _ob=F.col("proposed"))
    rows = rows.withColumn("_sql", equivalence(F.col("_a"), F.col("_b"))).withColumn("_orm", call_deltas(F.col("_oa"), F.col("_ob")))
    none = F.array().cast("array<string>")
    unread = F.struct(F.lit("unverifiable").alias("status"), none.alias("hard"), none.alias("soft"), none.alias("undecided"))
    orm = F.coalesce("_orm", unread)
    by_sql = {"sql": F.lit(True), "orm": F.lit(False), "auto": (F.col("_sql.status") != "unverifiable") | F.col("_orm").isNull()}[kind]
    told = rows.select("id", F.when(by_sql, "sql").otherwise("orm").alias("reader"), F.when(by_sql, F.col("_sql")).otherwise(orm).alias("_e"))
    return told.select("id", "reader", "_e.*")


def explain_recipe(engines: DataFrame) -> DataFrame:
    """(engine, family, plan, measure) for engines (engine): how a plan is shown and a statement measured; of a name that is not registered, what its family's are."""
    uses = engines.select("engine", F.lit(None).cast("string").alias("category"))
    return recipes.recipe_for(uses).select("engine", family_of(F.col("engine")).alias("family"), "plan", "measure")


def schema_facts(files: DataFrame, proposed: DataFrame | None = None) -> dict[str, DataFrame]:
    """tables, indexes, redundant (an index and the longer one that covers it), and advice on proposed indexes (id, text), of the definitions in files (path, content)."""
    tables, indexes = cut(ddl.table_facts(files), "tables"), cut(ddl.index_facts(files), "indexes")
    told = {"tables": tables, "indexes": indexes, "redundant": matching.prefix_covers(indexes.withColumn("id", F.col("ord")), "tab", "cols", "id", "uniq")}
    if proposed is not None:
        told["advice"] = ddl.index_advice(ddl.proposed_indexes(proposed), indexes, tables)
    return told


def equivalence_notes(ids: DataFrame, specs: DataFrame) -> DataFrame:
    """One row (notes): a line for each engine among ids (at, engine), in the order in which they come up first, of specs (engine, label, language, notes).

    A name that specs does not have counts as `unknown`. There are at most as many lines as specs has rows."""
    known = ids.join(F.broadcast(specs.select(F.col("engine").alias("_e"))), F.col("engine") == F.col("_e"), "left")
    first = known.groupBy(F.coalesce("_e", F.lit("unknown")).alias("engine")).agg(F.min("at").alias("at"))
    line = F.format_string("- **%s** (%s): %s", "label", "language", "notes")
    lines = first.join(F.broadcast(specs), "engine").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("_l"))
    return lines.select(F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("notes"))
