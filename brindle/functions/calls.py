"""Calls of data-access libraries in code: how many reach the database, in a loop or batched, and what they ask for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Dialect(NamedTuple):
    """Patterns of a library. sign: what tells it; calls: anything that touches data; trips: what costs a round trip. Patterns that say what is
    read (terminals, eager, projection, predicate, order) give their first group, and nothing without one."""

    name: str
    sign: str
    calls: str
    trips: str
    terminals: str
    eager: str
    projection: str
    limit: str
    predicate: str
    batched: str
    writes: str
    distinct: str
    order: str


# The libraries in the order in which they are tried, the first whose sign stands in the code counts.
DIALECTS = (
    Dialect(
        "django",
        sign=r"\.\s*objects\s*\.|\bQuerySet\b|\bF\s*\(|\bQ\s*\(|\bannotate\s*\(",
        calls=r"\.\s*objects\s*\.\s*\w+|\.\s*(?:count|exists|first|last|get|latest|earliest|aggregate|bulk_create|bulk_update|update|delete|create|save|in_bulk)\s*\(",
        trips=r"\.\s*(?:count|exists|first|last|get|latest|earliest|aggregate|in_bulk)\s*\(|\.\s*(?:save|delete|create|update|bulk_create|bulk_update|get_or_create|update_or_create)\s*\(|\bfor\s+\w+(?:\s*,\s*\w+)*\s+in\s+[\w.]*(?:\.objects\.|_set\.)|\b(?:list|len|any|all|sum|sorted|tuple|set)\s*\(\s*[^)]*?(?:\.objects\.|_set\.|\.queryset\b|\.\s*(?:filter|exclude|values_list|values|annotate|only|defer|select_related|prefetch_related)\s*\()",
        terminals=r"\.\s*(count|exists|first|last|get|all|aggregate|latest|earliest|values_list|values|in_bulk)\s*\(",
        eager=r"\b(select_related|prefetch_related|only|defer)\s*\(",
        projection=r"\.\s*(?:values|values_list|only)\s*\(([^)]*)\)",
        limit=r"\[\s*:\s*(\d+)\s*\]|\.\s*first\s*\(\s*\)",
        predicate=r"\.\s*(?:filter|exclude|get)\s*\(([^)]*)\)",
        batched=r"__in\s*=|\bin_bulk\s*\(|\bbulk_(?:create|update)\s*\(|\.\s*(?:update|delete)\s*\(|\bannotate\s*\(",
        writes=r"\.\s*(?:save|delete|create|update|bulk_create|bulk_update|get_or_create|update_or_create)\s*\(",
        distinct=r"\.\s*distinct\s*\(",
        order=r"\.\s*order_by\s*\(([^)]*)\)",
    ),
    Dialect(
        "activerecord",
        sign=r"\b[A-Z]\w*\s*\.\s*(?:where|find_by|find_each|pluck|includes|joins)\b|\bActiveRecord\b|\.\s*find_each\b",
        calls=r"\b[A-Z]\w*\s*\.\s*(?:where|find_by|find|all|first|last|count|exists\?|pluck|sum|average)\b|\.\s*(?:count|exists\?|first|last|pluck|sum|to_a|find_each|update|destroy|save)\b",
        trips=r"\.\s*(?:count|exists\?|first|last|pluck|sum|average|to_a|find_each|find_in_batches|find_by|find)\b|\.\s*(?:save!?|destroy!?|update!?|create!?|update_all|delete_all|insert_all)\b|\.\s*each\b",
        terminals=r"\.\s*(count|exists\?|first|last|pluck|to_a|sum|average|find_each)\b",
        eager=r"\.\s*(includes|preload|eager_load|left_outer_joins)\s*\(",
        projection=r"\.\s*(?:pluck|select)\s*\(([^)]*)\)",
        limit=r"\.\s*limit\s*\(\s*(\d+)\s*\)|\.\s*first\b",
        predicate=r"\.\s*(?:where|find_by)\s*[\(!]?([^)]*)\)?",
        batched=r"(?i)\bwhere\s*\(\s*\w+\s*:\s*\[|\bin_batches\b|\bfind_each\b|\bwhere\s*\(.*\bIN\b",
        writes=r"\.\s*(?:save!?|destroy!?|update!?|create!?|update_all|delete_all|insert_all)\b",
        distinct=r"\.\s*(?:distinct|uniq)\b",
        order=r"\.\s*order\s*\(([^)]*)\)",
    ),
    Dialect(
        "sqlalchemy",
        sign=r"\bsession\s*\.\s*(?:query|execute|scalars|scalar|get)\b|\bselect\s*\(\s*\w+\s*\)|\bjoinedload\b|\bselectinload\b",
        calls=r"\bsession\s*\.\s*(?:query|execute|scalars|scalar|get|add|delete|commit)\s*\(|\.\s*(?:all|one|one_or_none|first|count|scalar)\s*\(",
        trips=r"\.\s*(?:all|one|one_or_none|first|count|scalar)\s*\(|\bsession\s*\.\s*(?:execute|scalars|scalar|get|commit|flush|add|add_all|delete|merge)\s*\(",
        terminals=r"\.\s*(all|one|one_or_none|first|count|scalar)\s*\(",
        eager=r"\b(joinedload|selectinload|subqueryload|contains_eager)\s*\(",
        projection=r"\b(?:with_entities|select)\s*\(([^)]*)\)",
        limit=r"\.\s*limit\s*\(\s*(\d+)\s*\)|\.\s*first\s*\(\s*\)",
        predicate=r"\.\s*(?:filter|filter_by|where)\s*\(([^)]*)\)",
        batched=r"\.\s*in_\s*\(|\bbulk_(?:save_objects|insert_mappings)\b",
        writes=r"\bsession\s*\.\s*(?:add|add_all|delete|merge)\s*\(|\.\s*update\s*\(",
        distinct=r"\.\s*distinct\s*\(",
        order=r"\.\s*order_by\s*\(([^)]*)\)",
    ),
    Dialect(
        "prisma",
        sign=r"\bprisma\s*\.\s*\w+\s*\.\s*\w+|\$queryRaw|\$transaction",
        calls=r"\bprisma\s*\.\s*\w+\s*\.\s*(?:findMany|findFirst|findUnique|findUniqueOrThrow|count|aggregate|groupBy|create|createMany|update|updateMany|upsert|delete|deleteMany)\s*\(|\$queryRaw|\$executeRaw",
        trips=r"\bprisma\s*\.\s*\w+\s*\.\s*(?:findMany|findFirst|findUnique|findUniqueOrThrow|count|aggregate|groupBy|create|createMany|update|updateMany|upsert|delete|deleteMany)\s*\(|\$queryRaw|\$executeRaw",
        terminals=r"\.\s*(findMany|findFirst|findUnique|count|aggregate|groupBy)\s*\(",
        eager=r"\b(include|select)\s*:",
        projection=r"\bselect\s*:\s*\{([^}]*)\}",
        limit=r"\btake\s*:\s*(\d+)",
        predicate=r"\bwhere\s*:\s*\{([^}]*)\}",
        batched=r"\bin\s*:\s*\[|\bcreateMany\b|\bupdateMany\b|\$transaction\b",
        writes=r"\.\s*(?:create|createMany|update|updateMany|upsert|delete|deleteMany)\s*\(",
        distinct=r"\bdistinct\s*:",
        order=r"\borderBy\s*:\s*(\{[^}]*\}|\[[^\]]*\])",
    ),
    Dialect(
        "sequelize",
        sign=r"\.\s*(?:findAll|findAndCountAll|findByPk)\s*\(|\bSequelize\b|\bDataTypes\b",
        calls=r"\.\s*(?:findAll|findOne|findByPk|findAndCountAll|count|create|bulkCreate|update|destroy|increment)\s*\(",
        trips=r"\.\s*(?:findAll|findOne|findByPk|findAndCountAll|count|create|bulkCreate|update|destroy|increment|save)\s*\(",
        terminals=r"\.\s*(findAll|findOne|findByPk|findAndCountAll|count)\s*\(",
        eager=r"\binclude\s*:",
        projection=r"\battributes\s*:\s*\[([^\]]*)\]",
        limit=r"\blimit\s*:\s*(\d+)",
        predicate=r"\bwhere\s*:\s*\{([^}]*)\}",
        batched=r"\[\s*Op\.in\s*\]|\bbulkCreate\b",
        writes=r"\.\s*(?:create|bulkCreate|update|destroy|save|increment)\s*\(",
        distinct=r"\bdistinct\s*:\s*true",
        order=r"\border\s*:\s*(\[[^\]]*\])",
    ),
    Dialect(
        "typeorm",
        sign=r"\bcreateQueryBuilder\s*\(|\bgetRepository\s*\(|\bleftJoinAndSelect\b|@Entity\b",
        calls=r"\.\s*(?:getMany|getOne|getRawMany|getRawOne|getCount|find|findOne|findOneBy|findAndCount|save|insert|update|delete|remove)\s*\(",
        trips=r"\.\s*(?:getMany|getOne|getRawMany|getRawOne|getCount|find|findOne|findOneBy|findAndCount|save|insert|update|delete|remove|softDelete)\s*\(",
        terminals=r"\.\s*(getMany|getOne|getRawMany|getCount|find|findOne|findAndCount)\s*\(",
        eager=r"\.\s*(leftJoinAndSelect|innerJoinAndSelect)\s*\(|\brelations\s*:",
        projection=r"\.\s*select\s*\(\s*\[?([^)\]]*)\]?\s*\)",
        limit=r"\.\s*(?:take|limit)\s*\(\s*(\d+)\s*\)",
        predicate=r"\.\s*(?:where|andWhere)\s*\(([^)]*)\)",
        batched=r"\bIn\s*\(|\bwhereInIds\b",
        writes=r"\.\s*(?:save|insert|update|delete|remove|softDelete)\s*\(",
        distinct=r"\.\s*distinct\s*\(",
        order=r"\.\s*(?:orderBy|addOrderBy)\s*\(([^)]*)\)",
    ),
    Dialect(
        "gorm",
        sign=r"\b(?:db|tx)\s*\.\s*(?:Where|Preload|Model|Find|First|Joins)\s*\(",
        calls=r"\b(?:db|tx)\s*\.\s*(?:Find|First|Last|Take|Count|Pluck|Scan|Create|Save|Updates?|Delete|FindInBatches)\s*\(|\.\s*(?:Find|First|Count|Scan|Pluck)\s*\(",
        trips=r"\.\s*(?:Find|First|Last|Take|Count|Pluck|Scan|Create|Save|Updates?|Delete|FindInBatches|CreateInBatches)\s*\(",
        terminals=r"\.\s*(Find|First|Last|Take|Count|Pluck|Scan)\s*\(",
        eager=r"\.\s*Preload\s*\(|\.\s*Joins\s*\(",
        projection=r"\.\s*Select\s*\(([^)]*)\)",
        limit=r"\.\s*Limit\s*\(\s*(\d+)\s*\)",
        predicate=r"\.\s*Where\s*\(([^)]*)\)",
        batched=r"(?i)\bIN\s*\?|\bCreateInBatches\b|\bFindInBatches\b|\bIN\s*\(",
        writes=r"\.\s*(?:Create|Save|Updates?|Delete|CreateInBatches)\s*\(",
        distinct=r"\.\s*Distinct\s*\(",
        order=r"\.\s*Order\s*\(([^)]*)\)",
    ),
    Dialect(
        "hibernate",
        sign=r"\bEntityManager\b|\bcreateQuery\s*\(|\bCriteriaBuilder\b|@(?:Query|NamedQuery|EntityGraph)\b|\bgetResultList\b|@(?:OneToMany|ManyToMany|ManyToOne|OneToOne|ElementCollection)\b|\bFetchType\s*\.\s*(?:EAGER|LAZY)\b",
        calls=r"\.\s*(?:getResultList|getSingleResult|createQuery|createNativeQuery|find|persist|merge|remove|saveAll|save|findAll|findById|count)\s*\(",
        trips=r"\.\s*(?:getResultList|getSingleResult|getResultStream|find|persist|merge|remove|save|saveAll|saveAndFlush|delete|deleteAll|findAll|findById|count|flush)\s*\(",
        terminals=r"\.\s*(getResultList|getSingleResult|findAll|findById|count)\s*\(",
        eager=r"@EntityGraph\b|\bJOIN\s+FETCH\b|@BatchSize\b|\bFetchType\s*\.\s*EAGER\b",
        projection=r"(?i)\bSELECT\s+(?:new\s+\S+\s*\()?([\w.,\s]+?)\s+FROM\b",
        limit=r"\.\s*setMaxResults\s*\(\s*(\d+)\s*\)",
        predicate=r"(?i)\bWHERE\s+([^)]*?)(?:\bORDER\b|\bGROUP\b|$)",
        batched=r"(?i)\bIN\s*[(:]|\bsaveAll\b|@BatchSize\b",
        writes=r"\.\s*(?:persist|merge|remove|save|saveAll|delete|deleteAll)\s*\(",
        distinct=r"(?i)\bDISTINCT\b",
        order=r"(?i)\bORDER\s+BY\s+([\w.,\s]+)",
    ),
    Dialect(
        "efcore",
        sign=r"\bDbSet<|\.\s*Include\s*\(|\bAsNoTracking\s*\(|\bFromSqlRaw\b",
        calls=r"\.\s*(?:ToList|ToListAsync|First|FirstAsync|FirstOrDefault|FirstOrDefaultAsync|Single|SingleOrDefault|Count|CountAsync|Any|AnyAsync|Add|AddRange|Update|Remove|SaveChanges|SaveChangesAsync)\s*\(",
        trips=r"\.\s*(?:ToListA?s?y?n?c?|ToArrayA?s?y?n?c?|FirstA?s?y?n?c?|FirstOrDefaultA?s?y?n?c?|SingleA?s?y?n?c?|SingleOrDefaultA?s?y?n?c?|CountA?s?y?n?c?|AnyA?s?y?n?c?|SumA?s?y?n?c?|SaveChangesA?s?y?n?c?|ExecuteUpdateA?s?y?n?c?|ExecuteDeleteA?s?y?n?c?)\s*\(",
        terminals=r"\.\s*(ToListA?s?y?n?c?|FirstOrDefaultA?s?y?n?c?|FirstA?s?y?n?c?|CountA?s?y?n?c?|AnyA?s?y?n?c?)\s*\(",
        eager=r"\.\s*(Include|ThenInclude)\s*\(",
        projection=r"\.\s*Select\s*\(([^)]*)\)",
        limit=r"\.\s*Take\s*\(\s*(\d+)\s*\)",
        predicate=r"\.\s*Where\s*\(([^)]*)\)",
        batched=r"\.\s*Contains\s*\(|\bAddRange\b|\bUpdateRange\b",
        writes=r"\.\s*(?:Add|AddRange|Update|Remove|RemoveRange|SaveChanges|SaveChangesAsync)\s*\(",
        distinct=r"\.\s*Distinct\s*\(",
        order=r"\.\s*(?:OrderBy|OrderByDescending|ThenBy)\s*\(([^)]*)\)",
    ),
    Dialect(
        "mongoose",
        sign=r"\bmongoose\b|\.\s*populate\s*\(|\.\s*lean\s*\(",
        calls=r"\.\s*(?:find|findOne|findById|countDocuments|estimatedDocumentCount|aggregate|updateOne|updateMany|insertMany|deleteOne|deleteMany|save|bulkWrite)\s*\(",
        trips=r"\.\s*(?:find|findOne|findById|countDocuments|estimatedDocumentCount|aggregate|updateOne|updateMany|insertMany|deleteOne|deleteMany|save|bulkWrite|create|exec|lean)\s*\(",
        terminals=r"\.\s*(find|findOne|findById|countDocuments|aggregate)\s*\(",
        eager=r"\.\s*populate\s*\(",
        projection=r"\.\s*select\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*\)",
        limit=r"\.\s*limit\s*\(\s*(\d+)\s*\)",
        predicate=r"\.\s*find(?:One)?\s*\(\s*(\{[^}]*\})",
        batched=r"\$in\s*:|\binsertMany\b|\bbulkWrite\b",
        writes=r"\.\s*(?:save|updateOne|updateMany|insertMany|deleteOne|deleteMany|bulkWrite|create)\s*\(",
        distinct=r"\.\s*distinct\s*\(",
        order=r"\.\s*sort\s*\(([^)]*)\)",
    ),
    Dialect(
        "pymongo",
        sign=r"\.\s*(?:to_list|find_one|insert_one|insert_many|update_one|update_many|delete_one|delete_many|count_documents|estimated_document_count|bulk_write|replace_one|find_one_and_update|find_one_and_delete|find_one_and_replace)\s*\(|\bAsyncIOMotorClient\b|\bAsyncIOMotorDatabase\b|\bpymongo\b|\bmotor\.motor_asyncio\b",
        calls=r"\.\s*(?:find|find_one|aggregate|insert_one|insert_many|update_one|update_many|delete_one|delete_many|count_documents|estimated_document_count|bulk_write|replace_one|find_one_and_update|find_one_and_delete|find_one_and_replace|distinct|to_list|create_index)\s*\(",
        trips=r"\.\s*(?:to_list|find_one|insert_one|insert_many|update_one|update_many|delete_one|delete_many|count_documents|estimated_document_count|bulk_write|replace_one|find_one_and_update|find_one_and_delete|find_one_and_replace|distinct|create_index)\s*\(|\b(?:async\s+)?for\s+\w+(?:\s*,\s*\w+)*\s+in\s+[\w.]*\.\s*(?:find|aggregate)\s*\(",
        terminals=r"\.\s*(to_list|find_one|count_documents|estimated_document_count|distinct|aggregate)\s*\(",
        eager=r"(\$lookup)\b",
        projection=r"(?:\.\s*find(?:_one)?\s*\(\s*\{[^{}]*\}\s*,\s*|projection\s*=\s*)(\{[^{}]*\})",
        limit=r"\.\s*to_list\s*\(\s*(\d+)\s*\)|\.\s*limit\s*\(\s*\d+\s*\)",
        predicate=r"\.\s*find(?:_one)?\s*\(\s*(\{[^{}]*\})",
        batched=r"\$in\b|\binsert_many\b|\bbulk_write\b",
        writes=r"\.\s*(?:insert_one|insert_many|update_one|update_many|delete_one|delete_many|bulk_write|replace_one|find_one_and_update|find_one_and_delete|find_one_and_replace)\s*\(",
        distinct=r"\.\s*distinct\s*\(",
        order=r"\.\s*sort\s*\(([^)]*)\)",
    ),
)
# What code says whatever its library.
OWN_LOOP = r"(?m)^\s*(?:for|while)\b|\bfor\s*\(|\.\s*(?:forEach|each|map|find_each)\s*[({]|\bEnum\.each\b|\.\s*each\s+do\b"
MATERIALISED = r"(?i)\blist\s*\(|\.\s*to_a\b|\bArray\.from\s*\(|\btolist\s*\("
AGGREGATES = r"\b(Max|Min|Count|Sum|Avg|Coalesce)\s*\("
EAGER_MODE, LAZY_MODE = r"\bFetchType\s*\.\s*EAGER\b", r"\bFetchType\s*\.\s*LAZY\b"
CARDINALITY = ("count", "exists", "exists?", "first", "last", "get", "one", "one_or_none", "findOne", "findUnique", "getOne")
MQL_STAGES = "match|group|lookup|unwind|project|sort|limit|skip|facet|addFields|set|unset|bucket|bucketAuto|graphLookup|sample|count|merge|out|replaceRoot|replaceWith|sortByCount|densify|fill|setWindowFields|search|searchMeta|vectorSearch|geoNear|indexStats|unionWith"
# Fixed values: (style, pattern) of query languages that are no SQL, in order; key-value commands need a store's name too.
QUERY_LANGUAGES = (
    ("aggregation-pipeline", r"(?:^|[\{\[,\s])[\"']?\$(?:" + MQL_STAGES + r")[\"']?\s*:"),
    (
        "vector-search",
        r"\bquery_embeddings\s*=|\bn_results\s*=|\binclude_metadatas?\s*=|\btopK\s*[:=]|\btop_k\s*[:=]|\bquery_vector\s*[:=]|[\"']?vectors?[\"']?\s*:\s*(?:\[|embedding|vec)|\bwith_near_vector\s*\(|\bnear_vector\s*[:=]|\bcollection_name\s*=\s*[^,)]+,\s*query_|\bupsert\s*\(\s*(?:vectors\s*=|\[\s*\{[^}]*\bvalues\b)|\bsimilarity_search(?:_with_score|_by_vector)?\s*\(|\bas_retriever\s*\(",
    ),
    (
        "search-dsl",
        r"\b_(?:m?search|count)\b|[\"']?(?:must_not|match_phrase|match_all|multi_match|span_near|dis_max)[\"']?\s*:|[\"']?aggs?regations?[\"']?\s*:|[\"']aggs[\"']\s*:|[\"']?bool[\"']?\s*:\s*\{|[\"']?terms[\"']?\s*:\s*\{",
    ),
    ("graph-traversal", r"(?i:\b(?:OPTIONAL\s+)?MATCH\s*\(\s*\w*\s*:\s*\w+|\bMERGE\s*\(\s*\w*\s*:\s*\w+|\bCREATE\s*\(\s*\w*\s*:\s*\w+\s*\{)|\bg\s*\.\s*V\s*\(|\bg\s*\.\s*E\s*\(|\.\s*(?:out|in|both)(?:E|V)?\s*\(\s*['\"]"),
    (
        "object-query",
        r"\b(?:Scan|Query|GetItem|PutItem|UpdateItem|DeleteItem|BatchGetItem|BatchWriteItem|TransactGetItems|TransactWriteItems)Command\b|[\"']?TableName[\"']?\s*[:=]|\bKeyConditionExpression\s*[:=]|\bFilterExpression\s*[:=]|\bProjectionExpression\s*[:=]|\.\s*collection\s*\(\s*['\"][^'\"]+['\"]\s*\)\s*\.\s*(?:doc|where|orderBy|limit|get|add|set)\s*\(|\bfirestore\b|\bFieldValue\s*\.\s*serverTimestamp\b",
    ),
)
KV_STORE = r"(?i)\bredis\b|\bioredis\b|\bStrictRedis\b|\bRedisClient\b|\bvalkey\b|\bmemcach"
KV_COMMAND = r"(?i)\.\s*(?:keys|scan|hgetall|hmget|hset|hget|mget|mset|setex|getset|zrange|zrangebyscore|zadd|lrange|lpush|rpush|sadd|smembers|sinter|expire|ttl|pipeline|multi|flushall|flushdb)\s*\("
#: Matches that are counted of one pattern.
MOST = 501

#: The columns of a shape that is none.
NO_SHAPE = "struct<dialect:string,calls:int,trips:int,per_iteration:boolean,terminals:array<string>,eager:array<string>,projection:array<string>,row_limit:int,predicates:array<string>,batched:boolean,writes:boolean,distinct:boolean,order_by:array<string>,aggregates:array<string>,materialised:boolean,fetch_mode:string>"


def dialect(code: Column) -> Column:
    """The first library whose sign stands in the code, or null."""
    return F.coalesce(*[F.when(code.rlike(d.sign), F.lit(d.name)) for d in DIALECTS])


def with_call_shapes(df: DataFrame, loop_depth: Column, **snippets: Column) -> DataFrame:
    """df with a column for each of the named snippets: a struct of what its calls do; null for code of no library, or without a call or fetch mode.

    trips: calls that cost a round trip; per_iteration: in a loop (its own, or loop_depth above 0) and not batched. The library is told once a snippet; only its patterns are tried.
    """
    told = df.select("*", loop_depth.alias("_loops"), *[F.coalesce(c, F.lit("")).alias(f"_code_{n}") for n, c in snippets.items()])
    told = told.select("*", *[dialect(F.col(f"_code_{n}")).alias(f"_dialect_{n}") for n in snippets])
    return told.select(*df.columns, *[_shape(F.col(f"_code_{n}"), F.col(f"_dialect_{n}"), F.col("_loops")).alias(n) for n in snippets])


def _shape(code: Column, name: Column, loops: Column) -> Column:
    def of(make) -> Column:
        out = F
        for d in DIALECTS:
            out = out.when(name == d.name, make(d))
        return out

    none = F.array().cast("array<string>")
    every = lambda pattern: F.regexp_extract_all(code, F.lit(pattern), F.lit(1)) if "(" in pattern.replace("(?", "").replace(r"\(", "") else none
    tidy = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    distinct = lambda a: F.array_distinct(tidy(a))
    raw = of(lambda d: every(d.projection))
    fields = F.filter(F.transform(F.split(F.array_join(raw, ","), r"[,\s]+"), lambda x: F.regexp_replace(x, r"['\"`\[\]{}():]", "")), lambda x: ~x.isin("", "true", "false"))
    calls = F.least(of(lambda d: F.regexp_count(code, F.lit(d.calls))), F.lit(MOST))
    mode = F.when(code.rlike(EAGER_MODE), "eager").when(code.rlike(LAZY_MODE), "lazy")
    batched = of(lambda d: code.rlike(d.batched))
    limit = of(lambda d: F.when(code.rlike(d.limit), F.coalesce(F.regexp_extract(code, d.limit, 1).try_cast("int"), F.lit(1))))
    shape = F.struct(
        name.alias("dialect"),
        calls.alias("calls"),
        F.least(of(lambda d: F.regexp_count(code, F.lit(d.trips))), F.lit(MOST)).alias("trips"),
        (~batched & ((loops > 0) | code.rlike(OWN_LOOP))).alias("per_iteration"),
        distinct(of(lambda d: every(d.terminals))).alias("terminals"),
        distinct(of(lambda d: every(d.eager))).alias("eager"),
        F.when(F.size(raw) > 0, fields).alias("projection"),
        limit.alias("row_limit"),
        tidy(of(lambda d: every(d.predicate))).alias("predicates"),
        batched.alias("batched"),
        of(lambda d: code.rlike(d.writes)).alias("writes"),
        of(lambda d: code.rlike(d.distinct)).alias("distinct"),
        tidy(of(lambda d: every(d.order))).alias("order_by"),
        F.array_distinct(F.regexp_extract_all(code, F.lit(AGGREGATES), F.lit(1))).alias("aggregates"),
        code.rlike(MATERIALISED).alias("materialised"),
        mode.alias("fetch_mode"),
    )
    return F.when(name.isNotNull() & ((calls > 0) | mode.isNotNull()), shape)


def query_dsl(code: Column) -> Column:
    """The query language, other than SQL, that code is written in, or null."""
    return F.coalesce(*[F.when(code.rlike(p), F.lit(style)) for style, p in QUERY_LANGUAGES], F.when(code.rlike(KV_STORE) & code.rlike(KV_COMMAND), F.lit("kv-command")))


def _same(a: Column, b: Column) -> Column:
    plain = lambda x: F.array_sort(F.transform(x, lambda v: F.lower(F.regexp_replace(v, r"[\s'\"`]", ""))))
    return plain(a) == plain(b)


def call_deltas(a: Column, b: Column) -> Column:
    """struct(status, hard, soft, undecided) of two call shapes, null if either is none.

    A rewrite from one call an iteration to one batched call changes what the terminal returns (soft), and its rows are those of all iterations
    together, which the caller has to take as it took them one by one (undecided). Predicates are never proved.
    """
    widened = a["per_iteration"] & ~b["per_iteration"] & b["batched"] & (b["trips"] < a["trips"])
    ends = lambda s: F.filter(s["terminals"], lambda t: t.isin(*CARDINALITY))
    same_end = _same(ends(a), ends(b))
    ap, bp = a["projection"], b["projection"]
    named = lambda pairs: F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for t, n in pairs]), lambda x: x.isNotNull())
    hard = named([(ap.isNotNull() & bp.isNotNull() & ~_same(ap, bp), "projection"), (a["distinct"] != b["distinct"], "distinct"), (~same_end & ~widened, "terminal"), (a["writes"] != b["writes"], "writes")])
    soft = named([(ap.isNotNull() & bp.isNull(), "projection"), (~_same(a["order_by"], b["order_by"]), "order-by"), (~a["row_limit"].eqNullSafe(b["row_limit"]), "row-limit"), (~same_end & widened, "terminal")])
    undecided = named([(ap.isNull() & bp.isNotNull(), "projection"), (widened, "consumption"), (~widened & ~_same(a["predicates"], b["predicates"]), "predicates")])
    status = F.when(F.size(hard) > 0, "contradicted").when((F.size(soft) > 0) | (F.size(undecided) > 0), "partially-verified").otherwise("machine-verified")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(status.alias("status"), hard.alias("hard"), soft.alias("soft"), undecided.alias("undecided")))
