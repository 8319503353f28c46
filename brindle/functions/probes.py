"""Where a corpus says which engines it uses."""

from __future__ import annotations

MAX_CHARS = 400_000

# Authority, path, and (engine, pattern) of every declaration, without regard to case; ^ begins a line in manifests.
PROBES: tuple[tuple[int, str, tuple[tuple[str, str], ...]], ...] = (
    (100, r"(^|/)settings(?:/[\w.]+|_\w+)?\.py$|(^|/)settings\.py$|(^|/)config/settings", (
        ("postgres", r"django\.db\.backends\.postgresql(?:_psycopg2)?"), ("mysql", r"django\.db\.backends\.mysql"), ("sqlite", r"django\.db\.backends\.sqlite3"), ("oracle", r"django\.db\.backends\.oracle"), ("mssql", r"mssql|sql_server\.pyodbc"),
    )),
    (100, r"(^|/)config/database\.ya?ml$", (("postgres", r"adapter:\s*postgresql"), ("mysql", r"adapter:\s*mysql2?"), ("sqlite", r"adapter:\s*sqlite3?"), ("mysql", r"adapter:\s*trilogy"))),
    (100, r"(^|/)application(?:-\w+)?\.(?:properties|ya?ml)$", (
        ("postgres", r"jdbc:postgresql:"), ("mysql", r"jdbc:mysql:"), ("mariadb", r"jdbc:mariadb:"), ("mssql", r"jdbc:sqlserver:"), ("oracle", r"jdbc:oracle:"), ("sqlite", r"jdbc:h2:"), ("clickhouse", r"jdbc:clickhouse:"),
        ("mongodb", r"spring\.data\.mongodb"), ("redis", r"spring\.(?:redis|data\.redis)"), ("elasticsearch", r"spring\.elasticsearch|elasticsearch\.uris"),
    )),
    (100, r"(^|/)schema\.prisma$", (
        ("postgres", r'provider\s*=\s*"postgresql"'), ("mysql", r'provider\s*=\s*"mysql"'), ("sqlite", r'provider\s*=\s*"sqlite"'), ("mssql", r'provider\s*=\s*"sqlserver"'), ("mongodb", r'provider\s*=\s*"mongodb"'), ("cockroachdb", r'provider\s*=\s*"cockroachdb"'),
    )),
    (90, r"(^|/)(?:alembic\.ini|knexfile\.\w+|ormconfig\.\w+|sequelize\w*\.\w+|\.env\.example|drizzle\.config\.\w+)$", (
        ("postgres", r"postgres(?:ql)?://"), ("mysql", r"mysql://"), ("mariadb", r"mariadb://"), ("sqlite", r"sqlite:/{2,}"), ("mongodb", r"mongodb(?:\+srv)?://"), ("redis", r"redis://"), ("clickhouse", r"clickhouse://"),
    )),
    (70, r"(^|/)(?:requirements[\w.-]*\.txt|Pipfile|pyproject\.toml|setup\.py|constraints\.txt)$", (
        ("postgres", r"""^\s*["']?(?:psycopg2(?:-binary)?|asyncpg|psycopg)\b"""), ("mysql", r"""^\s*["']?(?:mysqlclient|PyMySQL|mysql-connector-python|aiomysql)\b"""), ("mariadb", r"""^\s*["']?mariadb\b"""), ("mongodb", r"""^\s*["']?pymongo\b|^\s*["']?motor\b"""),
        ("redis", r"""^\s*["']?(?:redis|aioredis)\b"""), ("elasticsearch", r"""^\s*["']?elasticsearch\b"""), ("opensearch", r"""^\s*["']?opensearch-py\b"""), ("snowflake", r"""^\s*["']?snowflake-connector-python\b"""), ("bigquery", r"""^\s*["']?google-cloud-bigquery\b"""),
        ("cassandra", r"""^\s*["']?cassandra-driver\b"""), ("pgvector", r"""^\s*["']?pgvector\b"""), ("clickhouse", r"""^\s*["']?clickhouse-(?:driver|connect)\b"""), ("duckdb", r"""^\s*["']?duckdb\b"""), ("influxdb", r"""^\s*["']?influxdb\b"""), ("neo4j", r"""^\s*["']?neo4j\b"""),
        ("pinecone", r"""^\s*["']?(?:pinecone-client|pinecone)\b"""), ("qdrant", r"""^\s*["']?qdrant-client\b"""), ("weaviate", r"""^\s*["']?(?:weaviate-client)\b"""), ("milvus", r"""^\s*["']?(?:pymilvus)\b"""), ("chroma", r"""^\s*["']?chromadb\b"""),
    )),
    (70, r"(^|/)package\.json$", (
        ("postgres", r'"(?:pg|postgres|pg-promise|@vercel/postgres)"\s*:'), ("mysql", r'"(?:mysql|mysql2)"\s*:'), ("mariadb", r'"mariadb"\s*:'), ("mongodb", r'"(?:mongodb|mongoose)"\s*:'), ("redis", r'"(?:redis|ioredis)"\s*:'), ("elasticsearch", r'"(?:@elastic/elasticsearch)"\s*:'),
        ("opensearch", r'"(?:@opensearch-project/opensearch)"\s*:'), ("sqlite", r'"(?:better-sqlite3|sqlite3)"\s*:'), ("mssql", r'"(?:mssql|tedious)"\s*:'), ("snowflake", r'"snowflake-sdk"\s*:'), ("bigquery", r'"@google-cloud/bigquery"\s*:'), ("dynamodb", r'"@aws-sdk/(?:client-dynamodb|lib-dynamodb)"\s*:'),
        ("cassandra", r'"(?:cassandra-driver)"\s*:'), ("neo4j", r'"(?:neo4j-driver)"\s*:'), ("pinecone", r'"@pinecone-database/pinecone"\s*:'), ("qdrant", r'"(?:@qdrant/js-client-rest)"\s*:'), ("weaviate", r'"(?:weaviate-ts-client|weaviate-client)"\s*:'), ("chroma", r'"(?:chromadb)"\s*:'), ("clickhouse", r'"(?:clickhouse|@clickhouse/client)"\s*:'),
    )),
    (70, r"(^|/)(?:go\.mod|pom\.xml|build\.gradle(?:\.kts)?|Gemfile|Cargo\.toml|[\w.-]+\.csproj)$", (
        ("postgres", r"lib/pq|jackc/pgx|postgresql-\d|org\.postgresql|tokio-postgres|\bpg\b\s*[,)]|Npgsql"), ("mysql", r"go-sql-driver/mysql|mysql-connector-j|com\.mysql|mysql2?\s*[,(]|MySqlConnector"), ("mariadb", r"mariadb-java-client|mariadb\b"), ("sqlite", r"mattn/go-sqlite3|sqlite-jdbc|rusqlite|sqlite3\b"),
        ("mongodb", r"mongo-driver|mongodb-driver|mongoid"), ("redis", r"go-redis|redigo|jedis|lettuce-core|StackExchange\.Redis|redis-rb"), ("elasticsearch", r"elasticsearch-(?:java|rest|rails)|olivere/elastic"), ("opensearch", r"opensearch-java|opensearch-ruby"),
        ("mssql", r"mssql-jdbc|denisenkom/go-mssqldb|System\.Data\.SqlClient|Microsoft\.Data\.SqlClient"), ("oracle", r"ojdbc|oracle\.jdbc|ruby-oci8"), ("snowflake", r"snowflake-jdbc|gosnowflake"), ("bigquery", r"google-cloud-bigquery|bigquery"), ("cassandra", r"cassandra-driver-core|gocql"),
        ("neo4j", r"neo4j-java-driver|neo4j-driver"), ("clickhouse", r"clickhouse-jdbc|clickhouse-go"), ("dynamodb", r"aws-sdk-go.*dynamodb|dynamodb-enhanced|AWSSDK\.DynamoDBv2"),
    )),
    (60, r"(^|/)(?:docker-compose[\w.-]*\.ya?ml|compose[\w.-]*\.ya?ml)$", (
        ("postgres", r"""image:\s*["']?(?:postgres|postgis|bitnami/postgresql)"""), ("mysql", r"""image:\s*["']?(?:mysql|bitnami/mysql|percona)"""), ("mariadb", r"""image:\s*["']?mariadb"""), ("mongodb", r"""image:\s*["']?mongo"""), ("redis", r"""image:\s*["']?redis"""),
        ("elasticsearch", r"""image:\s*["']?(?:elasticsearch|docker\.elastic\.co)"""), ("opensearch", r"""image:\s*["']?opensearchproject"""), ("clickhouse", r"""image:\s*["']?(?:clickhouse|yandex/clickhouse)"""), ("cassandra", r"""image:\s*["']?cassandra"""), ("neo4j", r"""image:\s*["']?neo4j"""),
        ("timescaledb", r"""image:\s*["']?(?:timescale|timescaledb)"""), ("mssql", r"""image:\s*["']?(?:mcr\.microsoft\.com/mssql|mssql)"""), ("unknown", r"""image:\s*["']?(?:qdrant|weaviate|milvus|chromadb)"""),
    )),
)
