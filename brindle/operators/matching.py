"""Joins with a tolerance, by prefix, with fallbacks, and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.operators.report import observed_names
from brindle.session import cut


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose numbers a (left) and b (right) differ by at most the tolerance.

    Numbers are dealt to buckets a tolerance and a half wide; the right side stands in its own bucket and its neighbours, so that one hot key is
    spread over buckets and a row meets only its surroundings, instead of all rows of its key.
    """
    width = 2 * tolerance + 1
    near = F.explode(F.array(*[F.floor(F.col(b) / width) + k for k in (-1, 0, 1)]))
    r = right.withColumn("_bucket", near).withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k) == F.col(f"_r{k}") for k in keys] + [F.floor(F.col(a) / width) == F.col("_bucket"), F.abs(F.col(a) - F.col(b)) <= tolerance]
    return left.join(r, on, how).drop("_bucket", *(f"_r{k}" for k in keys))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: int, row_key: list[str], tie: list[str]) -> DataFrame:
    """Every left row with the first right row within the tolerance, by distance and tie; unmatched rows keep nulls."""
    joined = tolerance_join(left, right, keys, a, b, tolerance, "left")
    order = Window.partitionBy(*row_key).orderBy(F.abs(F.col(a) - F.col(b)).asc_nulls_last(), *tie)
    return joined.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def found_both_ways(findings: DataFrame, truths: DataFrame, candidates: DataFrame, keys: list[str], at: str, tolerance: int) -> dict[str, DataFrame]:
    """Semi-joins within a tolerance: `real`, findings near some truth; `found`, truths near some finding; `covered`, truths near some candidate, found or not."""
    of = lambda t: t.select(*keys, F.col(at).alias("_at"))
    near = lambda a, b: tolerance_join(a, of(b), keys, at, "_at", tolerance, "left_semi")
    return {"real": near(findings, truths), "found": near(truths, findings), "covered": near(truths, candidates)}


def prefix_covers(indexes: DataFrame, table: str, columns: str, row_id: str, unique: str) -> DataFrame:
    """(row_id, covered_by): indexes that a strictly longer one of the same table begins with; unique ones are never redundant; the first cover counts.

    Every index stands under each of its own proper prefixes, so that the join is one of equality. Of each prefix the first two ids are kept, since an index
    is not its own cover: what an index meets does not grow with the number of those that begin alike.
    """
    keys = ["_t", "_prefix"]
    prefixes = indexes.filter(F.size(columns) > 1).select(F.lower(table).alias("_t"), F.explode(F.transform(F.sequence(F.lit(1), F.size(columns) - 1), lambda n: F.slice(F.col(columns), 1, n))).alias("_prefix"), F.col(row_id).alias("_by"))
    first = prefixes.distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_by"))).filter("_n <= 2")
    covers = first.groupBy(*keys).agg(F.collect_list("_by").alias("_covers"))
    short = indexes.filter(~F.col(unique)).select(F.lower(table).alias("_t"), row_id, F.col(columns).alias("_prefix"))
    met = join_hot(short, covers, keys, hot_keys(short.groupBy(*keys).agg(F.count("*").alias("n")), keys), [row_id])
    return met.select(row_id, F.explode("_covers").alias("_by")).filter(F.col(row_id) != F.col("_by")).groupBy(row_id).agg(F.min("_by").alias("covered_by"))


def merged_catalogs(declared: DataFrame, observed: DataFrame, table: str, name: str, columns: str, row_id: str) -> DataFrame:
    """(table, name, columns, origin): declared indexes, those seen in a database too marked 'both', then the observed ones that none claims.

    An observed index matches by name, or by its columns; the first match counts.
    """
    o = observed.select(F.lower(table).alias("_t"), F.col(name).alias("_name"), F.col(columns).alias("_columns"), F.col(row_id).alias("_oid"))
    d = declared.withColumn("_t", F.lower(table))
    by_name = d.join(o, [d["_t"] == o["_t"], d[name] == o["_name"]]).select(d[row_id], "_oid")
    by_columns = d.join(o, [d["_t"] == o["_t"], d[columns] == o["_columns"]]).select(d[row_id], "_oid")
    claimed = by_name.union(by_columns).groupBy(row_id).agg(F.min("_oid").alias("_oid"))
    mine = d.join(claimed, row_id, "left").select(table, name, columns, F.when(F.col("_oid").isNotNull(), "both").otherwise("declared").alias("origin"))
    rest = observed.join(claimed.select(F.col("_oid").alias(row_id)).distinct(), row_id, "left_anti").select(table, name, columns, F.lit("observed").alias("origin"))
    return mine.unionByName(rest)


def _plain(name: Column) -> Column:
    """A name in lower case, without a quote at either end."""
    return F.regexp_replace(F.lower(name), r"^[\"`]|[\"`]$", "")


def _same_columns(columns: Column) -> Column:
    """Lists of columns that are alike, whatever their case and quotes, as one text; null without columns, which match nothing."""
    return F.when(F.size(columns) > 0, F.to_json(F.transform(columns, _plain)))


def grounded_catalog(declared: DataFrame, observed: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(tab, name, cols, uniq, origin, scans, size_bytes, observed, live_rows, distinct, null_fraction, width): declared indexes and those of a database as one catalog.

    declared: id, tab, name, cols, uniq; observed: tab, name, cols, uniq, scans, size_bytes, ord; tables: tab, live_rows; columns: tab, col, distinct, null_fraction,
    width. A declared index is 'both' if an observed one of its table has its name or its columns; the first in ord counts, and several declared ones may
    match the same. It takes the observed name, and the observed columns where there are any. Observed indexes whose table and name no match has follow as 'observed'. observed
    tells whether the captures cover the table at all; live_rows are the table's, the other figures those of the leading column. Statistics that repeat
    count once, the last in order of their values. Tables with very many indexes are dealt in parts where they meet their figures; names are compared
    by equality, so that no two indexes of a table meet but for a shared name or column list. Null tables match nothing.
    """
    key = lambda d, on: d.select("*", _plain(F.col("tab")).alias("_t"), on.alias("_k"))
    o = observed.select(F.struct("tab", "name", "cols", "uniq", "scans", "size_bytes").alias("_o"), F.col("ord").alias("_ord"), "tab", "name", "cols")
    d = declared.withColumn("_row", F.monotonically_increasing_id())
    d = cut(d, "declared")
    matches = []
    for on in (_plain(F.col("name")), _same_columns(F.col("cols"))):
        left, right = key(d.select("_row", "tab", "name", "cols"), on), key(o, on).groupBy("_t", "_k").agg(F.min(F.struct("_ord", "_o")).alias("_first"))
        matches.append(left.select("_row", "_t", "_k").join(right.hint("merge"), ["_t", "_k"]).select("_row", "_first"))
    claimed = cut(matches[0].union(matches[1]).groupBy("_row").agg(F.min("_first").alias("_first")), "claimed")
    mine = d.join(claimed.hint("merge"), "_row", "left").select(
        "tab",
        F.coalesce(F.nullif(F.col("_first._o.name"), F.lit("")), "name").alias("name"),
        F.when(F.size("_first._o.cols") > 0, F.col("_first._o.cols")).otherwise(F.col("cols")).alias("cols"),
        "uniq",
        F.when(F.col("_first").isNotNull(), "both").otherwise("declared").alias("origin"),
        F.col("_first._o.scans").alias("scans"),
        F.col("_first._o.size_bytes").alias("size_bytes"),
    )
    taken = claimed.select(_plain(F.col("_first._o.tab")).alias("_t"), _plain(F.col("_first._o.name")).alias("_k")).distinct()
    rest = key(observed, _plain(F.col("name"))).join(taken.hint("merge"), ["_t", "_k"], "left_anti").select("tab", "name", "cols", "uniq", F.lit("observed").alias("origin"), "scans", "size_bytes")
    every = cut(mine.unionByName(rest).withColumns({"_t": _plain(F.col("tab")), "_c": _plain(F.get("cols", F.lit(0)))}), "catalog")
    seen = observed_names(*[x.select(_plain(F.col("tab")).alias("tab")) for x in (observed, tables, columns)]).select(F.col("tab").alias("_t"), F.lit(True).alias("_seen"))
    counts = tables.filter("live_rows IS NOT NULL").groupBy(_plain(F.col("tab")).alias("_t")).agg(F.max("live_rows").alias("live_rows"))
    known = seen.join(counts.hint("merge"), "_t", "left")
    figures = columns.groupBy(_plain(F.col("tab")).alias("_t"), _plain(F.col("col")).alias("_c")).agg(F.max(F.struct("distinct", "null_fraction", "width")).alias("_f"))
    told = join_hot(every, known, ["_t"], hot_keys(every.groupBy("_t").agg(F.count("*").alias("n")), ["_t"]), ["name"], "left")
    hot = hot_keys(every.groupBy("_t", "_c").agg(F.count("*").alias("n")), ["_t", "_c"])
    told = join_hot(told, figures, ["_t", "_c"], hot, ["name"], "left")
    return told.select("tab", "name", "cols", "uniq", "origin", "scans", "size_bytes", F.coalesce("_seen", F.lit(False)).alias("observed"), "live_rows", "_f.distinct", "_f.null_fraction", "_f.width")


#: Characters of a key that are looked up; shorter keys are looked up whole.
GRAM = 6
#: Words of 64 bits of the table that tells which pieces may be looked up: at most so many rows are broadcast.
WORDS = 1 << 19


def contained(texts: DataFrame, keys: DataFrame, text: str, key: str, gram: int = GRAM) -> DataFrame:
    """Rows of texts with the rows of keys whose key stands in the text, as a join of equality on pieces of `gram` characters.

    Of each key the piece is looked up that the fewest keys have, so that keys that begin alike, or share a folder, don't meet every text that does; a
    text stands under each of its different pieces, of the lengths that pieces have, and what meets is checked. Empty and null keys and texts meet nothing.
    """
    named = keys.filter(F.length(key) > 0).withColumn("_key", F.monotonically_increasing_id())
    named = cut(named, "keys")
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    size = F.least(F.length(key), F.lit(gram))
    held = named.select("_key", F.explode(pieces(F.col(key), size)).alias("_piece"))
    rare = held.join(held.groupBy("_piece").agg(F.count("*").alias("_n")).hint("merge"), "_piece").groupBy("_key").agg(F.min(F.struct("_n", "_piece")).alias("_p"))
    looked = cut(named.join(rare.select("_key", F.col("_p._piece").alias("_piece")).hint("merge"), "_key").drop("_key"), "looked")
    # At most `gram` lengths.
    lengths = [r[0] for r in looked.select(F.length("_piece").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return texts.limit(0).join(keys.limit(0))
    t = F.col(text)
    every = F.concat(*[F.when(F.length(t) >= n, pieces(t, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths])
    # A text has hundreds of pieces, and most are looked up by no key: a table of bits by hash, of bounded size, leaves them out where the text is read.
    hashed = F.xxhash64("_piece")
    word, bit = F.pmod(hashed, F.lit(WORDS)).alias("_word"), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    bits = looked.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    some = texts.withColumn("_piece", F.explode(every)).withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word").filter(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bits", "_bit")
    return some.join(looked.hint("merge"), "_piece").filter(F.contains(t, F.col(key))).drop("_piece")


def adjudicated(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """runs (run, path) with the adjudication (key, adjudicated, ord) whose key stands anywhere in the run's path, across folders too: the first in order."""
    first = contained(runs.select("run", "path"), verdicts, "path", "key").groupBy("run").agg(F.min_by("adjudicated", "ord").alias("adjudicated"))
    return runs.join(first, "run", "left")


def coalesced(parts: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the first value that is not null, in order. Field-wise minima of (order, value) need no sort."""
    first = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f)
    return parts.groupBy(*keys).agg(*[first(f) for f in fields])


def reconciled(sent: DataFrame, answered: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status): answered (its first answer counts), unaccounted (sent only), invented (answered only)."""
    s = sent.select(F.col(key).alias("_s")).distinct()
    a = answered.groupBy(F.col(key).alias("_a")).agg(F.min(order).alias("first_answer"))
    status = F.when(F.col("_a").isNull(), "unaccounted").when(F.col("_s").isNull(), "invented").otherwise("answered")
    return s.join(a, F.col("_s") == F.col("_a"), "full").select(F.coalesce("_s", "_a").alias(key), status.alias("status"), "first_answer")


# What may follow a model's name and leave it the same model: dates, channels, revisions.
VERSION_TOKEN = r"(?:\d{8}|\d{6}|\d{3}|\d{4}-\d{2}-\d{2}|latest|preview|stable|exp|experimental|v\d+)"
VERSION_REST = rf"(?i)^[-@]+{VERSION_TOKEN}(?:[-@]+{VERSION_TOKEN})*[-@]*$"


def longest_prefix(rows: DataFrame, table: DataFrame, name: str, prefix: str, value: str, rest: str | None = None) -> DataFrame:
    """Every row with the value of the longest prefix of its name in a table, by equality on each of the name's beginnings; null without one.

    rest: a pattern that what follows the prefix must match, where anything follows."""
    beginnings = rows.select(F.col(name).alias("_full")).distinct().select("_full", F.explode(F.transform(F.sequence(F.lit(1), F.length("_full")), lambda n: F.substring("_full", F.lit(1), n))).alias(prefix))
    found = beginnings.join(table, prefix)
    if rest is not None:
        after = F.substring("_full", F.length(prefix) + 1, F.length("_full"))
        found = found.filter((after == "") | after.rlike(rest))
    best = found.groupBy("_full").agg(F.max_by(value, F.length(prefix)).alias(value))
    return rows.join(best, rows[name] == best["_full"], "left").drop("_full")


def price_for(models: DataFrame, prices: DataFrame, model: str = "model", base: str = "base", price: str = "price") -> DataFrame:
    """models with the price of the longest base (base, price) that is the model itself, or the model without a date, a channel or a revision; null for any other suffix."""
    return longest_prefix(models, prices, model, base, price, VERSION_REST)


def authored_sites(authored: DataFrame, sites: DataFrame, keys: list[str], a: str, b: str, tolerance: int, row_key: str, claimed: str, site: str) -> DataFrame:
    """(row_key, site): the site that each authored row is about: the one it names (claimed) if there is such a site, else the first one near what it cites; null without either."""
    known = sites.select(F.col(site).alias("_site"))
    named = authored.join(known, authored[claimed] == F.col("_site"))
    rest = authored.join(named.select(row_key), row_key, "left_anti")
    near = nearest_within(rest, sites, keys, a, b, tolerance, [row_key], [site])
    return named.select(row_key, F.col("_site").alias(site)).unionByName(near.select(row_key, site))


def set_changes(a: Column, b: Column) -> Column:
    """struct(added, removed): what the list b has beside a, and a beside b, without regard to order, case, quotes and white space; each name once."""
    plain = lambda x: F.array_distinct(F.transform(x, lambda v: F.regexp_replace(F.lower(v), "[\"'` \t\r\n]", "")))
    return F.struct(F.array_sort(F.array_except(plain(b), plain(a))).alias("added"), F.array_sort(F.array_except(plain(a), plain(b))).alias("removed"))


def next_requests(sent: DataFrame, answered: DataFrame, site: str, attempt: str, most: int = 2) -> DataFrame:
    """(site, attempt): sites that no answer accounts for after their last attempt, once each, with the number of the next one; a site is asked `most` times at most."""
    last = sent.filter(F.col(site).isNotNull()).groupBy(site).agg(F.max(attempt).alias(attempt))
    silent = last.join(answered.select(F.col(site).alias("_s")).distinct().hint("merge"), F.col(site) == F.col("_s"), "left_anti")
    return silent.filter(F.col(attempt) < most).select(site, (F.col(attempt) + 1).alias(attempt))


def same_set(a: Column, b: Column) -> Column:
    """Equality of two lists without regard to order, case, quotes and white space; repeats count."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[\"'` \t\r\n]", "")
    return F.array_sort(F.transform(a, plain)) == F.array_sort(F.transform(b, plain))
