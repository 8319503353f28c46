"""Exact dedup by content hash, with a comparison of bytes inside each hash group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.session import cut

SPACE = r"[\x20\x09-\x0D]+"
#: 2^65 and 2^63: a text's length and its row's id share one decimal, so that the aggregate keeps a fixed-width buffer.
_LENGTH_UNIT, _ID_TOP = "36893488147419103232", "9223372036854775808"


def _rank(n_chars: Column, row_id: Column) -> Column:
    """Larger: more code points, then a smaller id; rows without an id come last."""
    unit, top = F.lit(_LENGTH_UNIT).cast("decimal(20,0)"), F.lit(_ID_TOP).cast("decimal(20,0)")
    by_id = F.coalesce(top - row_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n_chars.cast("decimal(10,0)") * unit + by_id).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    unit, top = F.lit(_LENGTH_UNIT).cast("decimal(20,0)"), F.lit(_ID_TOP).cast("decimal(20,0)")
    rest = rank % unit
    return F.when(rest > 0, (top - rest).cast("long"))


def content_hash(text_col: str = "text") -> Column:
    """text_sha256 of a row: the SHA-256 of its text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_tied.

    Texts are equal when identical without white space ([\\x20\\x09-\\x0D]); a null text is empty. Rows are grouped by the
    128-bit MD5 of that text and, inside a hash group, by the text itself, so that rows whose hashes collide stay apart;
    map-side aggregation leaves one row per task and distinct text before the shuffle, and where classes meet their rows, hot
    texts are dealt in parts. Of equal texts the row with the most code points in its original text stays, then the smallest id (rows
    without an id last); of rows that agree in all of this (n_tied of them) one stays. Other columns are ignored; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, SPACE, "")
    rank = _rank(F.col("_n"), F.col("doc_id"))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("_n"), bare.alias("_bare")).withColumn("_hash", F.md5("_bare"))
    # Texts meet here only: one row a class is written, and rows without their texts.
    best = hashed.groupBy("_hash", "_bare").agg(F.count("*").alias("group_size"), F.max(rank).alias("_best"))
    keys = ["_hash", "text_sha256"]
    classes = cut(best.select("_hash", F.sha2("_bare", 256).alias("text_sha256"), "group_size", "_best"), "classes")
    own = cut(hashed.select("doc_id", "_hash", F.sha2("_bare", 256).alias("text_sha256"), rank.alias("_rank"), F.monotonically_increasing_id().alias("_row")), "rows")
    hot = hot_keys(classes, keys, "group_size")
    joined = join_hot(own, classes, keys, hot, ["_row"]).withColumn("_top", F.col("_rank") == F.col("_best"))
    # Rows that tie for the first place differ in nothing but where they stand.
    ties = cut(joined.filter("_top").groupBy(*keys).agg(F.count("*").alias("n_tied"), F.min("_row").alias("_first")).filter("n_tied > 1"), "ties")
    told = join_hot(joined, ties, keys, hot, ["_row"], "left")
    return told.select(
        "doc_id",
        _id_of(F.col("_best")).alias("keep_id"),
        "group_size",
        (F.col("_top") & (F.col("_first").isNull() | (F.col("_row") == F.col("_first")))).alias("kept"),
        "text_sha256",
        F.coalesce("n_tied", F.when(F.col("_top"), F.lit(1))).cast("long").alias("n_tied"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY bare) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM d
"""
