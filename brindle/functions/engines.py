"""The engines a query can be for: families, dialects, and what a path says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Engines by family; unknown stands for every other name.
FAMILIES = (
    ("rdbms", "postgres mysql mariadb mssql oracle sqlite db2 unknown"),
    ("distributed-sql", "cockroachdb tidb yugabyte spanner vitess"),
    ("warehouse", "snowflake bigquery redshift synapse databricks athena clickhouse"),
    ("bigdata", "hive spark trino impala hbase hadoop"),
    ("document", "mongodb couchdb dynamodb firestore cosmosdb"),
    ("wide-column", "cassandra scylla bigtable"),
    ("key-value", "redis memcached etcd hazelcast ignite"),
    ("graph", "neo4j neptune arangodb"),
    ("search", "elasticsearch opensearch solr"),
    ("vector", "pgvector pinecone weaviate qdrant milvus chroma faiss"),
    ("timeseries", "influxdb timescaledb prometheus druid questdb"),
    ("object-embedded", "objectdb realm duckdb rocksdb tinydb"),
)
# Engines that are one dialect, the first for all of them.
DIALECTS = (("mysql", "mariadb"), ("postgres", "pgvector", "timescaledb", "cockroachdb"))
_ROOT = r"(?:^|/)(?:db|database|sql|ddl|migrations?)/(?:[^/]*/)?"
# Paths named after an engine, without regard to case; the first counts.
PATHS = (
    ("postgres", _ROOT + r"postgres(?:ql)?(?:/|[-_.])"), ("mysql", _ROOT + r"mysql(?:/|[-_.])"), ("mariadb", _ROOT + r"mariadb(?:/|[-_.])"), ("sqlite", _ROOT + r"sqlite(?:/|[-_.])"), ("mssql", _ROOT + r"(?:mssql|sqlserver)(?:/|[-_.])"),
    ("oracle", _ROOT + r"oracle(?:/|[-_.])"), ("clickhouse", _ROOT + r"clickhouse(?:/|[-_.])"), ("postgres", r"application-postgres(?:ql)?\.(?:properties|ya?ml)$"), ("mysql", r"application-mysql\.(?:properties|ya?ml)$"),
)
ENGINES = tuple(e for _, names in FAMILIES for e in names.split())


def family_of(engine: Column) -> Column:
    """The engine's family; that of unknown for a name that is not registered."""
    out = F.lit(FAMILIES[0][0])
    for family, names in FAMILIES:
        out = F.when(engine.isin(*names.split()), family).otherwise(out)
    return out


def dialect_of(engine: Column) -> Column:
    out = engine
    for first, *others in DIALECTS:
        out = F.when(engine.isin(*others), first).otherwise(out)
    return out


def engine_from_path(path: Column) -> Column:
    """The engine that a path names, or null."""
    return F.coalesce(*[F.when(F.lower(path).rlike(p), F.lit(e)) for e, p in PATHS])
