"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from brindle.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else str(v) if hasattr(v, "isoformat") else v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    rows = con.fetchall()
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    same(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
