"""Queries over statements: one per row of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.shapes import normalise_shape
from brindle.tables import table


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, sql): the statement an application would send for each order."""
    orders = table(spark, sf_dir, "orders")
    sql = F.concat(
        F.lit("SELECT "), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")), F.lit(", o_totalprice FROM orders WHERE o_orderkey = "),
        F.col("o_orderkey").cast("string"), F.lit(" AND o_orderstatus IN ('"), F.col("o_orderstatus"), F.lit("', 'it''s')  AND o_custkey = $1"),
    )
    return orders.select("o_orderkey", "o_custkey", sql.alias("sql"))


_STATEMENTS = """(SELECT o_orderkey, o_custkey, 'SELECT ' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || ', o_totalprice FROM orders WHERE o_orderkey = '
  || CAST(o_orderkey AS VARCHAR) || ' AND o_orderstatus IN (''' || o_orderstatus || ''', ''it''''s'')  AND o_custkey = $1' AS sql FROM orders)"""


def _sql_shape(col: str) -> str:
    out = rf"regexp_replace(regexp_replace({col}, '''[^'']*''', '?', 'g'), '\?\?+', '?', 'g')"
    out = rf"regexp_replace({out}, '\$[0-9]+', '?', 'g')"
    out = rf"regexp_replace({out}, '\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g')"
    out = rf"regexp_replace({out}, '(?i)\bin\s*\(\s*\?(?:\s*,\s*\?)*\s*\)', 'IN (?)', 'g')"
    out = rf"regexp_replace({out}, '[ \t\r\n]+', ' ', 'g')"
    return f"substring(trim({out}), 1, 200)"


def log_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape: Column = normalise_shape(F.col("sql"))
    return statements(spark, sf_dir).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_seen"))


QUERIES = {"log_shapes": log_shapes}
ORACLE_SQL = {"log_shapes": f"SELECT {_sql_shape('sql')} AS shape, count(*) AS n, min(o_orderkey) AS first_seen FROM {_STATEMENTS} s GROUP BY 1"}
