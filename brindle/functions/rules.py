"""The detection rules, as a table."""

from __future__ import annotations

from dataclasses import dataclass

# Extensions by language group.
GROUPS = {
    "js": "js jsx ts tsx mjs cjs mts svelte vue",
    "py": "py pyi pyx ipynb",
    "jvm": "java kt kts scala groovy clj cljs",
    "dotnet": "cs fs vb",
}
_VERBS = r'SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|WITH\s+[\w"]+\s+AS|MERGE\s+INTO|UPSERT\s+INTO'
_QUOTE = r"(?:\"\"\"|'''|\x60|\"|')"


@dataclass(frozen=True)
class Rule:
    """confidence in hundredths; extensions: none for every file; anywhere: also in strings, not only in code; cased: letters as written."""

    name: str
    engine: str
    style: str
    confidence: int
    pattern: str
    extensions: str = ""
    cased: bool = True
    anywhere: bool = True


# Name, engine, access style, confidence and pattern of every rule, in the order that breaks ties.
RULES: tuple[Rule, ...] = (
    Rule("sql-in-string-literal", "unknown", "raw-sql", 75, rf"{_QUOTE}\s*(?:{_VERBS})\b[\s\S]{{0,1500}}?(?:FROM|INTO|SET|VALUES|WHERE)\b", cased=False),
    Rule("sql-file", "unknown", "ddl-migration", 95, rf"(?:{_VERBS}|CREATE\s+(?:TABLE|INDEX|UNIQUE\s+INDEX|VIEW|MATERIALIZED\s+VIEW)|ALTER\s+TABLE)\b", "sql ddl psql", cased=False),
    Rule("postgres-placeholder", "postgres", "raw-sql", 85, r"(?:SELECT|INSERT|UPDATE|DELETE)[\s\S]{0,600}?\$\d+", cased=False),
    Rule("postgres-dialect", "postgres", "raw-sql", 80, r'\bON\s+CONFLICT\b|\bRETURNING\s+[\w"*]+|\bILIKE\b|\bLATERAL\s+JOIN\b|::\w+\[\]|\bjsonb_\w+'),
    Rule("mysql-dialect", "mysql", "raw-sql", 85, r"\b(?:ON\s+DUPLICATE\s+KEY\s+UPDATE|STRAIGHT_JOIN|SQL_CALC_FOUND_ROWS|GROUP_CONCAT)\b"),
    Rule("mssql-dialect", "mssql", "raw-sql", 85, r"\bSELECT\s+TOP\s+\d+|WITH\s*\(\s*NOLOCK\s*\)|OPTION\s*\(\s*RECOMPILE|\bOUTPUT\s+INSERTED\b", cased=False),
    Rule("oracle-dialect", "oracle", "raw-sql", 80, r"\bROWNUM\b|\bCONNECT\s+BY\b|\bDUAL\b|\bNVL\s*\(|\bMERGE\s+INTO\s+\w+\s+USING\b"),
    Rule("sqlite-dialect", "sqlite", "raw-sql", 85, r"\bsqlite3?\s*\.\s*(?:connect|Database)\s*\(|\bPRAGMA\s+\w+", cased=False),
    Rule("snowflake", "snowflake", "raw-sql", 90, r"\bQUALIFY\b|\bLATERAL\s+FLATTEN\b|\bSNOWFLAKE\.ACCOUNT_USAGE\b|\bWAREHOUSE\s*=|\bCOPY\s+INTO\s+@|\bsnowflake\.connector\b"),
    Rule("bigquery", "bigquery", "raw-sql", 85, r"\bbigquery\b|\bBigQueryClient\b|`[\w-]+\.[\w-]+\.[\w-]+`|_PARTITIONTIME|_TABLE_SUFFIX|\bTABLESAMPLE\s+SYSTEM\b", cased=False),
    Rule("redshift", "redshift", "raw-sql", 85, r"\bDISTKEY\b|\bSORTKEY\b|\bDISTSTYLE\b|\bUNLOAD\s+\(|\bredshift\b", cased=False),
    Rule("synapse", "synapse", "raw-sql", 80, r"\b(?:CREATE\s+TABLE\s+.*WITH\s*\(\s*DISTRIBUTION|synapse)\b", cased=False, anywhere=False),
    Rule("databricks-delta", "databricks", "raw-sql", 85, r"\bOPTIMIZE\s+\w+\s+ZORDER\b|\bdelta\.`|\bDeltaTable\b|\bspark\.read\.format\([\"']delta", cased=False),
    Rule("athena", "athena", "raw-sql", 80, r"\b(?:athena|start_query_execution|AwsDataCatalog)\b", cased=False, anywhere=False),
    Rule("clickhouse", "clickhouse", "raw-sql", 90, r"\bPREWHERE\b|\bMergeTree\b|\bSETTINGS\s+max_threads\b|\bclickhouse\b"),
    Rule("hive", "hive", "raw-sql", 90, r"\bHiveContext\b|\bCREATE\s+EXTERNAL\s+TABLE\b|\bSTORED\s+AS\s+(?:PARQUET|ORC|TEXTFILE)\b|\bSORT\s+BY\b|\bDISTRIBUTE\s+BY\b|\bMSCK\s+REPAIR\b"),
    Rule("hive-file", "hive", "raw-sql", 95, r"\b(?:SELECT|INSERT\s+OVERWRITE|CREATE\s+TABLE)\b", "hql q", cased=False),
    Rule("spark-sql", "spark", "raw-sql", 85, r"\bspark\s*\.\s*sql\s*\(|\bsparkSession\s*\.\s*sql\s*\(|\.\s*(?:repartition|coalesce|broadcast|persist|cache)\s*\(|\bSparkSession\b"),
    Rule("spark-dataframe", "spark", "query-builder", 75, r"\bdf\s*\.\s*(?:select|filter|where|groupBy|join|withColumn|agg)\s*\(", "@py scala java"),
    Rule("trino-presto", "trino", "raw-sql", 80, r"\b(?:trino|presto|prestodb)\b|\bcatalog\.schema\.table\b", cased=False, anywhere=False),
    Rule("impala", "impala", "raw-sql", 80, r"\b(?:impala|impyla)\b|\bCOMPUTE\s+STATS\b", cased=False, anywhere=False),
    Rule("hbase", "hbase", "kv-command", 85, r"\bnew\s+Scan\s*\(|\bHTable\b|\bsetStartRow\b|\bsetStopRow\b|\bhappybase\b|\bGet\s*\(\s*Bytes\.toBytes"),
    Rule("mapreduce", "hadoop", "map-reduce", 85, r"\bextends\s+(?:Mapper|Reducer)\s*<|\bsetCombinerClass\b|\bJobConf\b", "@jvm"),
    Rule("mongodb-pipeline", "mongodb", "aggregation-pipeline", 80, r"\$(?:lookup|unwind|match|group|facet|graphLookup|bucket|addFields|project|sortByCount|replaceRoot)\b|\.\s*aggregate\s*\(\s*\["),
    Rule("mongodb-crud", "mongodb", "orm", 80, r"\b(?:db|database|mongo|mongoose|collection|coll|col|[A-Z]\w+)(?:\s*\.\s*\w+)?\s*\.\s*(?:find|findOne|findOneAndUpdate|findOneAndDelete|findOneAndReplace|updateMany|updateOne|replaceOne|insertMany|insertOne|deleteMany|deleteOne|countDocuments|estimatedDocumentCount|distinct|createIndex|bulkWrite)\s*\(\s*(?:\{|filter\b|query\b|criteria\b|where\b|\))"),
    Rule("mongoose", "mongodb", "orm", 85, r"\b(?:mongoose\s*\.\s*model|Schema\s*\(\s*\{|\.\s*populate\s*\(|\.\s*lean\s*\(\s*\))", "@js"),
    Rule("dynamodb", "dynamodb", "rest-data-api", 90, r"\bnew\s+(?:Scan|Query|GetItem|PutItem|UpdateItem|DeleteItem|BatchGetItem|BatchWriteItem|TransactWriteItems|ExecuteStatement)Command\b|\b(?:DynamoDBClient|DynamoDBDocumentClient|documentClient|docClient|dynamoDb|dynamodb)\b|\b(?:KeyConditionExpression|FilterExpression|ProjectionExpression|ExpressionAttributeValues|ExpressionAttributeNames|ConsistentRead)\b"),
    Rule("firestore", "firestore", "rest-data-api", 85, r"\b(?:firestore\s*\(\s*\)|collection\s*\(\s*[\"'][\w-]+[\"']\s*\)\s*\.\s*where|onSnapshot|FieldPath)\b"),
    Rule("cosmosdb", "cosmosdb", "rest-data-api", 85, r"\b(?:CosmosClient|RequestCharge|PartitionKey|EnableCrossPartitionQuery)\b"),
    Rule("couchdb", "couchdb", "rest-data-api", 75, r"\b(?:couchdb|Mango)\b|_design/|\bselector\s*:\s*\{", cased=False, anywhere=False),
    Rule("cassandra-cql", "cassandra", "raw-sql", 90, r"\bALLOW\s+FILTERING\b|\bUSING\s+TTL\b|\bSimpleStatement\b|\b[Cc]assandra\b|\bexecute_concurrent\b"),
    Rule("cql-file", "cassandra", "ddl-migration", 95, r"\b(?:SELECT|INSERT\s+INTO|CREATE\s+(?:TABLE|KEYSPACE))\b", "cql", cased=False),
    Rule("scylla", "scylla", "raw-sql", 80, r"\b(?:scylla|shard_aware)\b", cased=False, anywhere=False),
    Rule("bigtable", "bigtable", "kv-command", 85, r"\b(?:bigtable|read_rows|RowSet|row_key_prefix)\b"),
    Rule("redis-scan-risk", "redis", "kv-command", 90, r"\b(?:redis|jedis|ioredis|redisClient|redis_client|cache|rdb|conn)\s*\.\s*(?:keys|flushall|flushdb)\s*\(|[\"'\x60]\s*(?:KEYS\s+\*|FLUSHALL|FLUSHDB)", cased=False),
    Rule("redis", "redis", "kv-command", 85, r"\b(?:redis|jedis|ioredis|redisClient|cache)\s*\.\s*(?:scan|hgetall|hmget|mget|mset|pipeline|multi|smembers|sinter|zrange|zadd|zrangebyscore|setex|expire|ttl|lrange|rpush|lpop|incrby)\s*\(|\bStackExchange\.Redis\b|\bIDatabase\s+\w*[Rr]edis", cased=False),
    Rule("memcached", "memcached", "kv-command", 80, r"\b(?:memcache|pylibmc|get_multi|Memcached)\b", cased=False, anywhere=False),
    Rule("etcd", "etcd", "kv-command", 80, r"\b(?:etcd|clientv3)\b|\bWithPrefix\(\)", anywhere=False),
    Rule("hazelcast-ignite", "hazelcast", "query-builder", 80, r"\b(?:Hazelcast|IgniteCache|SqlFieldsQuery)\b|\bIMap<", "@jvm"),
    Rule("cypher", "neo4j", "graph-traversal", 90, r"\bMATCH\s*\(\s*\w*\s*:\s*\w+|\bMERGE\s*\(\s*\w*\s*:|\[\s*:\s*\w+\s*\*\s*\.\.|\bRETURN\s+DISTINCT\b"),
    Rule("cypher-file", "neo4j", "graph-traversal", 95, r"\b(?:MATCH|MERGE|CREATE)\s*\(", "cypher cyp"),
    Rule("gremlin", "neptune", "graph-traversal", 85, r"\bg\s*\.\s*V\s*\(|\btraversal\s*\(\s*\)|\bGraphTraversalSource\b|\.\s*(?:outE|inE|outV|inV|bothE|bothV|hasLabel|valueMap)\s*\("),
    Rule("aql-sparql", "arangodb", "graph-traversal", 80, r"\bFOR\s+\w+\s+IN\s+\w+[\s\S]{0,200}?RETURN\b|\bPREFIX\s+\w+:\s*<"),
    Rule("elasticsearch", "elasticsearch", "search-dsl", 82, r'"query"\s*:\s*\{\s*"(?:bool|match|match_all|match_phrase|term|terms|range|nested|multi_match|query_string|function_score|dis_max)"|"(?:must_not|should|minimum_should_match|search_after|track_total_hits|aggregations)"\s*:|"aggs"\s*:\s*\{|\b(?:es|esClient|elastic|elasticClient|opensearch|osClient)\s*\.\s*(?:search|msearch|count|scroll)\s*\('),
    Rule("opensearch", "opensearch", "search-dsl", 85, r"\bfrom\s+opensearchpy\s+import\b|\bimport\s+opensearchpy\b|\brequire\s*\(\s*['\"\x60]@opensearch-project/|\bfrom\s+['\"\x60]@opensearch-project/|\bnew\s+OpenSearchClient\s*\(|\bOpenSearch\s*\(\s*\{|\borg\.opensearch\.client\b", anywhere=False),
    Rule("solr", "solr", "search-dsl", 80, r"\b(?:solr|SolrQuery|[?&]fq=|[?&]defType=)\b", cased=False, anywhere=False),
    Rule("pgvector", "pgvector", "vector-search", 92, r"(?:\s(?:<->|<=>|<#>)\s)|\bvector\s*\(\s*\d+\s*\)|\bivfflat\b|\bhnsw\b|ef_search|SET\s+ivfflat\.probes", cased=False),
    Rule("pinecone", "pinecone", "vector-search", 85, r"\b(?:pinecone|topK|top_k)\b|\.\s*upsert\s*\(\s*vectors", cased=False),
    Rule("weaviate", "weaviate", "vector-search", 88, r"\b(?:weaviate|nearVector|nearText|withHybrid)\b|\balpha\s*:", cased=False),
    Rule("qdrant", "qdrant", "vector-search", 88, r"\b(?:qdrant|hnsw_ef|search_params|with_payload)\b", cased=False),
    Rule("milvus", "milvus", "vector-search", 88, r"\b(?:milvus|pymilvus|nprobe)\b|\bcollection\.search\s*\(", cased=False),
    Rule("chroma", "chroma", "vector-search", 85, r"\b(?:chromadb|chroma_client)\b|\.\s*query\s*\(\s*query_embeddings", cased=False),
    Rule("faiss", "faiss", "vector-search", 90, r"\b(?:faiss|IndexFlatL2|IndexIVFFlat|IndexHNSW)\b"),
    Rule("influxdb", "influxdb", "timeseries-query", 88, r"\binflux|\bfrom\s*\(\s*bucket\s*:|\|>\s*range\s*\(|\bInfluxQL\b", cased=False),
    Rule("timescaledb", "timescaledb", "timeseries-query", 90, r"\bcreate_hypertable\b|\btime_bucket\s*\(|\bcontinuous\s+aggregate\b|\btimescaledb\b", cased=False),
    Rule("promql", "prometheus", "timeseries-query", 85, r"\b(?:rate|irate|histogram_quantile|increase)\s*\(\s*\w+\{|prometheus_client|PromQL"),
    Rule("druid", "druid", "timeseries-query", 80, r"\bdruid\b|__time\b|\bgranularity\s*:\s*[\"']", cased=False, anywhere=False),
    Rule("questdb", "questdb", "timeseries-query", 85, r"\bquestdb\b|\bSAMPLE\s+BY\b|\bLATEST\s+ON\b", cased=False, anywhere=False),
    Rule("objectdb-jpql", "objectdb", "object-query", 85, r"\b(?:objectdb|JDOQL)\b|\bcreateQuery\s*\(\s*[\"']SELECT\s+\w+\s+FROM\b", cased=False),
    Rule("realm", "realm", "object-query", 80, r"\b(?:realm\s*\.\s*objects|RealmResults|\.\s*filter\s*\(\s*[\"'][\w\s=]+[\"']\s*\))"),
    Rule("duckdb", "duckdb", "raw-sql", 88, r"\bduckdb\b|\bread_parquet\s*\(|\bread_csv_auto\s*\(", cased=False),
    Rule("rocksdb", "rocksdb", "kv-command", 85, r"\b(?:rocksdb|leveldb|NewIterator|SeekToFirst|WriteBatch)\b", cased=False),
    Rule("pydb-embedded", "tinydb", "object-query", 85, r"\b(?:tinydb|TinyDB|shelve\.open|dbm\.open|pickledb)\b", "@py"),
    Rule("node-pg-mysql", "unknown", "raw-sql", 82, rf"\b(?:pool|client|db|conn|connection|sql)\s*\.\s*(?:query|execute)\s*\(\s*[\x60'\"][\s\S]{{0,60}}?(?:{_VERBS})\b", "@js", cased=False),
    Rule("python-dbapi", "unknown", "raw-sql", 72, r"\bcursor\s*\.\s*execute(?:many)?\s*\(|\bconn(?:ection)?\s*\.\s*(?:fetch|fetchrow|fetchval|execute)\s*\(|\bpd\s*\.\s*read_sql\w*\s*\(", "@py"),
    Rule("jdbc", "unknown", "raw-sql", 80, r"\b(?:prepareStatement|createStatement|executeQuery|executeUpdate|NamedParameterJdbcTemplate|jdbcTemplate)\b", "@jvm"),
    Rule("go-database-sql", "unknown", "raw-sql", 80, r"\b(?:db|tx)\s*\.\s*(?:Query|QueryRow|Exec|QueryContext|ExecContext|NamedExec|Select|Get)\s*\(", "go"),
    Rule("dotnet-ado-dapper", "mssql", "raw-sql", 78, r"\b(?:SqlCommand|ExecuteReader|ExecuteScalar|\.\s*Query(?:Async)?<|\.\s*QueryFirstOrDefault)\b", "@dotnet"),
    Rule("rust-sqlx-diesel", "unknown", "raw-sql", 82, r"\b(?:sqlx::query|query_as!|diesel::|\.\s*load::<)", "rs"),
    Rule("php-pdo", "unknown", "raw-sql", 80, r"\$(?:pdo|db|conn)\s*->\s*(?:prepare|query|exec)\s*\(|\bDB::(?:table|select|raw)\s*\(", "php"),
    Rule("elixir-ecto", "postgres", "orm", 80, r"\bRepo\s*\.\s*(?:all|one|get|preload|aggregate)\s*\(|\bfrom\s+\w+\s+in\s+\w+", "ex exs"),
    Rule("prisma", "unknown", "orm", 90, r"\bprisma\s*\.\s*\w+\s*\.\s*(?:findMany|findFirst|findUnique|count|aggregate|groupBy|update|create|delete|upsert)\s*\(|\$queryRaw|\$executeRaw", "@js"),
    Rule("typeorm-sequelize", "unknown", "orm", 78, r"\.\s*(?:findAll|findOne|findAndCountAll|createQueryBuilder|getRepository|leftJoinAndSelect)\s*\(", "@js"),
    Rule("knex-drizzle", "unknown", "query-builder", 78, r"\bknex\s*\(|\bknex\s*\.\s*\w+|\bdrizzle\s*\(|\b(?:db|tx|trx)\s*\.\s*(?:select|insert|update|delete)\s*\(|\.\s*(?:leftJoin|innerJoin|rightJoin|whereIn|whereNotIn|havingRaw|onConflict)\s*\(", "@js"),
    Rule("sqlalchemy", "unknown", "orm", 82, r"\bsession\s*\.\s*(?:query|execute|scalars)\s*\(|\bselect\s*\(\s*\w+\s*\)\s*\.\s*where\s*\(|\bjoinedload\s*\(|\bselectinload\s*\(", "@py"),
    Rule("django-orm", "unknown", "orm", 85, r"\.\s*objects\s*\.\s*(?:filter|exclude|get|all|annotate|aggregate|values|values_list|select_related|prefetch_related|bulk_create)\s*\(", "@py"),
    Rule("activerecord", "unknown", "orm", 75, r"\b[A-Z]\w*\s*\.\s*(?:where|joins|includes|find_by|pluck|group|find_each|all|order|limit)\s*[\(.]|\.\s*(?:find_each|find_in_batches|includes|joins|left_outer_joins|pluck)\s*\(", "rb"),
    Rule("gorm", "unknown", "orm", 75, r"\b(?:db|tx)\s*\.\s*(?:Where|Preload|Joins|Find|First|Model|Scan)\s*\(", "go"),
    Rule("xorm", "unknown", "orm", 78, r"\bdb\s*\.\s*GetEngine\s*\(|\bdb\s*\.\s*(?:Insert|Find|Get|Count|Exist|Update|Delete|Iterate|WithTx)\s*\(\s*ctx\b|\b(?:sess|session|x|e|engine)\s*\.\s*(?:ID|Where|Table|Cols|In|Limit|Join|SQL|Asc|Desc)\s*\([^)]*\)\s*(?:\.\s*\w+\s*\([^)]*\)\s*)*\.\s*(?:Find|Get|Count|Exist|Update|Insert|Delete|Iterate|Rows)\s*\(|\b(?:sess|session)\s*\.\s*(?:Insert|Update|Delete|Get|Find|Count|Exist|Iterate)\s*\(", "go"),
    Rule("hibernate-jpa", "unknown", "orm", 80, r"@(?:Query|NamedQuery|EntityGraph)\s*\(|\bcreateQuery\s*\(|\bEntityManager\b|\bCriteriaBuilder\b|FetchType\.(?:LAZY|EAGER)", "@jvm"),
    Rule("ef-core", "mssql", "orm", 82, r"\b(?:DbSet<|\.\s*Include\s*\(|\.\s*ThenInclude\s*\(|AsNoTracking\s*\(\s*\)|FromSqlRaw)\b", "@dotnet"),
    Rule("sql-fragment-concat", "unknown", "raw-sql", 70, r"(?:\+=|\+\s*)?[\"'\x60]\s*(?:AND|OR)?\s*(?:FROM|WHERE|INNER\s+JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|JOIN|ORDER\s+BY|GROUP\s+BY|HAVING|LIMIT|OFFSET|VALUES|SET)\s", cased=False),
    Rule("sql-string-building", "unknown", "raw-sql", 72, r"\b(?:sql|query|stmt|statement|q)\b\s*(?:\+=|\.=|<<=|=\s*\w+\s*\+)", cased=False),
    Rule("prisma-schema", "unknown", "ddl-migration", 95, r"\bmodel\s+\w+\s*\{|@@index\s*\(|@@unique\s*\(", "prisma"),
    Rule("migration-dsl", "unknown", "ddl-migration", 85, r"\b(?:add_index|create_table|addColumn|createIndex|op\.create_index|op\.add_column|schema\.create)\b"),
)


def extensions(rule: Rule) -> frozenset[str]:
    """The extensions a rule is for; empty for all."""
    return frozenset(x for e in rule.extensions.split() for x in (GROUPS[e[1:]].split() if e.startswith("@") else [e]))


#: Engines that are themselves SQL dialects, which outrank a hint at a driver.
DIALECTS = ("postgres", "mysql", "mariadb", "mssql", "oracle", "sqlite", "cockroachdb", "db2")
#: Comment and quote marks by extension; line marks | block pairs | quotes | whether a backslash escapes.
SYNTAX = (
    ("js jsx ts tsx mjs cjs mts cts svelte vue java kt kts scala groovy go rs swift dart zig c cc cpp h hpp m mm cs fs php json5 prisma", "//", "/* */", "` \" '", True),
    ("py pyi pyx rb pl r jl ex exs sh bash zsh yaml yml toml cfg ini", "#", "", "\"\"\" ''' \" '", True),
    ("sql ddl psql hql q", "--", "/* */", "\" ' `", False),
    ("cql", "--", "/* */", "\" '", False),
    ("cypher cyp", "//", "/* */", "\" '", True),
    ("lua", "--", "--[[ ]]", "\" '", True),
    ("erl", "%", "", '"', True),
    ("clj cljs", ";", "", '"', True),
    ("vb", "'", "", '"', False),
    ("html xml", "", "<!-- -->", "\" '", False),
)
