"""A pipeline from raw documents to encoded training text.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents (COLUMNS), and drop others that docs may have. Any column may be null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from brindle.session import cut, scratch
from brindle.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows that agree in keys, counted from 1, so that each can be told apart from its copies."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))))


def _matched(docs: DataFrame, decided: DataFrame, keys: list[str], how: str) -> DataFrame:
    """docs joined with decided on keys, nulls alike. Both grow with the corpus: a merge join at every size."""
    right = decided.withColumnsRenamed({k: f"_r{k}" for k in keys}).hint("merge")
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return docs.join(right, on, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic; it learns from the labels of the documents at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).filter(F.col("_score") < model.threshold).select(COLUMNS)


def _one_of_each(docs: DataFrame, kept: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of docs whose keys are in kept (keys, n: how many such rows docs has); where n is above 1, the first of them in order."""
    rows = join_hot(docs.select(*COLUMNS, *keys), kept, keys, hot_keys(kept, keys), ["n_chars"])
    first = rows.filter("n > 1").groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *COLUMNS)).alias("_first"))
    return rows.filter("n = 1").select(COLUMNS).unionByName(first.select("_first.*").select(COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that exact dedup keeps; of rows that repeat it, id and all, one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    told = exact_dedup.exact_dedup(docs).groupBy(key.alias("key"), "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    kept = cut(told.filter("kept").drop("kept"), "kept")
    keyed = docs.select(*COLUMNS, key.alias("key"), exact_dedup.content_hash("text").alias("text_sha256"))
    return _one_of_each(keyed, kept, ["key", "text_sha256"], -F.length(F.coalesce("text", F.lit(""))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id, rows without an id last. Documents without words all stay."""
    keys = ["key", "text_hash"]
    told = cut(ngram_join.ngram_classes(docs).groupBy(*keys).agg(F.count("*").alias("n"), F.max("component").alias("component"), F.min("doc_id").isNull().alias("none")), "told")
    chosen = told.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("none", *keys)).alias("_of")).select("_of.*").drop("none")
    kept = told.filter("component IS NULL").select(*keys, F.lit(1).cast("long").alias("n")).union(told.select(*keys, "n").join(chosen.hint("merge"), keys))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(*COLUMNS, text_hash.alias("text_hash"), F.coalesce(F.col("doc_id"), text_hash).alias("key"))
    return _one_of_each(keyed, cut(kept, "kept"), keys)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    # A repeated row is told from its copies by its place among them: they take the same turns in either order.
    keys = ["doc_id", "source", "size"]
    mixed = mixing.mix(docs).filter("taken > 0").select(*keys, F.expr("cast(taken / size as int)").alias("times"))
    taken = _numbered(mixed, keys, F.col("times").desc())
    rows = _numbered(docs.select(*COLUMNS, mixing.n_words("text").alias("size")).filter("size > 0"), keys, F.xxhash64("text"))
    return _matched(rows, taken, [*keys, "_n"], "inner").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, for every row of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The classifier, the near-copy join by hashes and the encoder are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written for itself is deleted when its result is; that of the last but one is what the caller reads."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            rows = kept(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
