"""Merkle manifest of a dataset: a leaf for every row, a tree for every language, one root, and a proof for every leaf.

Rows are ranked inside their language over a range sort. The binary digits of a rank are grouped away one after the other inside
blocks of consecutive ranks, each grouping nesting two child structs in one; what is left of a block is one row with its root
and its tree. Block roots are the leaves of the next blocks, until every language has one root, and the languages' roots make the last tree. Going
down, the siblings above a block meet its tree in one grouping, and a transform and an explode emit a row for every leaf with all its
siblings: no leaf is joined with anything. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.running import range_sorted
from brindle.session import cut

#: A block has up to 2^BLOCK_BITS leaves, at any size of the dataset.
BLOCK_BITS = 8
_PATH = "array<struct<left: string, right: string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 (lowercase hex) of the five fields: `-` for null, else the length in UTF-8 bytes, `:` and the value."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (grp, ord, _row, ...) with rank (from 0, inside grp by ord) and nodes (rows of grp).

    Places come from a range sort; a table with a row for each range and group in it tells where a group begins.
    """
    placed = range_sorted(rows, F.col("grp").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("_row"))
    group = Window.partitionBy("grp")
    counts = placed.groupBy("_part", "grp").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_part").alias("_p"), F.col("grp").alias("_g"), (before - F.col("_first")).alias("_start"), F.sum("_n").over(group).alias("nodes"))
    met = placed.join(starts.hint("merge"), (F.col("_part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_g")))
    return met.withColumn("rank", F.col("_at") + F.col("_start")).drop("_part", "_at", "_p", "_g", "_start", "ord", "_row")


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """(grp, block, nodes, tree) of rows (grp, rank, nodes, tree); nodes: leaves of the whole group, tree: (hash, ...), of an inner node (hash, kids).

    Blocks are dealt once; every further grouping finds its rows where they are.
    """
    digits = [f"_d{k}" for k in range(bits)]
    rows = rows.select("grp", "nodes", "tree", F.shiftright("rank", bits).alias("block"), *[F.shiftright("rank", k).bitwiseAND(F.lit(1)).cast("tinyint").alias(d) for k, d in enumerate(digits)])
    rows = rows.repartition("grp", "block")
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("side"), "tree"))).alias("kids")
        rows = rows.groupBy("grp", "block", "nodes", *digits[k + 1 :]).agg(kids)
        # A level with one node left is the root: what stands above it in the block only hands it on.
        joined = F.concat_ws("", F.transform("kids", lambda kid: kid["tree"]["hash"]))
        tree = F.struct(F.when(F.col("nodes") > (1 << k), F.sha2(joined, 256)).otherwise(F.col("kids")[0]["tree"]["hash"]).alias("hash"), "kids")
        rows = rows.select("grp", "block", "nodes", *digits[k + 1 :], tree.alias("tree"))
    return rows


def _emitted(tree: Column, depth: int, nodes: Column, path: Column) -> Column:
    """array of (node, path) for the leaves of a tree of `depth` levels; path: siblings from the leaf upwards, ending in those of the tree itself."""
    if depth == 0:
        return F.array(F.struct(tree.alias("node"), path.alias("path")))
    kids = tree["kids"]

    def below(kid: Column, i: Column) -> Column:
        step = F.struct(F.when(i == 1, kids[0]["tree"]["hash"]).alias("left"), F.when(i == 0, F.get(kids, F.lit(1))["tree"]["hash"]).alias("right"))
        own = F.when(nodes > (1 << (depth - 1)), F.concat(F.array(step).cast(_PATH), path)).otherwise(path)
        return _emitted(kid["tree"], depth - 1, nodes, own)

    return F.flatten(F.transform(kids, below))


def _levels(rows: DataFrame, bits: int) -> list[DataFrame]:
    """Trees of rows (grp, rank, nodes, tree), then of their blocks' roots and so on, until every group has one block."""
    levels = []
    while True:
        trees = cut(_blocks(rows, bits), "trees")
        levels.append(trees)
        if (trees.agg(F.max("block")).first()[0] or 0) == 0:
            return levels
        above = F.ceil(F.col("nodes") / (1 << bits)).cast("long")
        rows = trees.select("grp", F.col("block").alias("rank"), above.alias("nodes"), F.struct(F.col("tree.hash").alias("hash")).alias("tree"))
        # A root's place is the block that it stands for.
        rows = rows.withColumn("tree", F.struct("tree.hash", F.col("rank").alias("place")))


_ABOVE = ["path", "subroot", "root"]


def _met(trees: DataFrame, above: DataFrame) -> DataFrame:
    """trees (grp, block, nodes, tree) with path, subroot and root of their block, of above (grp, block, ...): one row of each kind a block, brought together by a grouping."""
    both = trees.unionByName(above, allowMissingColumns=True)
    return both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("nodes", "tree", *_ABOVE)])


def _down(levels: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """(grp, node, path, subroot, root) for every leaf of the lowest level; above: a row for the one block of each group of the highest."""
    for k, trees in reversed(list(enumerate(levels))):
        met = _met(trees, above)
        leaves = met.select("grp", "subroot", "root", F.explode(_emitted(F.col("tree"), bits, F.col("nodes"), F.col("path"))).alias("_leaf")).select("grp", "subroot", "root", "_leaf.node", "_leaf.path")
        if k == 0:
            return leaves
        above = cut(leaves.select("grp", F.col("node.place").alias("block"), *_ABOVE), "above")
    raise ValueError("a tree has at least one level")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, from below, give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(F.coalesce(s["left"], F.lit("")), h, F.coalesce(s["right"], F.lit(""))), 256))


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path, tampered for every row of docs (doc_id, source, lang, n_chars, text).

    Per lang (null is one of its own) leaves ascend by doc_id (null first; rows that repeat an id by their leaf, and equal leaves are alike);
    every two consecutive nodes become the hash of both, a last one without a partner its own hash, while a level has more than one node.
    The roots of all languages, null first, then bytewise, likewise give root. path has a (left, right) for every level, each null where there is
    no sibling. tampered: the leaf with n_chars + 1. Other columns are ignored; an empty table gives an empty result; a text may be
    of any length, only its digest leaves the task that reads it.
    """
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    others = [F.col(c) for c in ("source", "lang")]
    read = docs.select(
        F.col("lang").alias("grp"),
        doc_id.alias("doc_id"),
        leaf_hash(doc_id, *others, n_chars, F.col("text")).alias("leaf"),
        F.when(F.crc32(doc_id.cast("string")) % 7 == 0, leaf_hash(doc_id, *others, n_chars + 1, F.col("text"))).alias("tampered"),
    )
    leaves = cut(read, "leaves").withColumn("_row", F.monotonically_increasing_id())
    ranked = _ranked(leaves.withColumn("ord", F.struct("doc_id", "leaf")))
    levels = _levels(ranked.select("grp", "rank", "nodes", F.struct(F.col("leaf").alias("hash"), "doc_id", "tampered").alias("tree")), bits)
    # Languages are rows like others: however many there are, they are dealt in blocks too.
    named = levels[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("ord"), F.col("tree.hash").alias("hash"), F.monotonically_increasing_id().alias("_row"))
    roots = _ranked(named.withColumn("lang", F.col("ord")))
    upper = _levels(roots.select("grp", "rank", "nodes", F.struct("hash", "lang").alias("tree")), bits)
    top = upper[-1].select("grp", "block", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("tree.hash").alias("root"))
    of_lang = cut(_down(upper, top, bits).select(F.col("node.lang").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("node.hash").alias("subroot"), "root"), "above")
    return _down(levels, of_lang, bits).select(F.col("node.doc_id").alias("doc_id"), F.col("grp").alias("lang"), F.col("node.hash").alias("leaf"), "subroot", "root", "path", F.col("node.tampered").alias("tampered"))


def verified(told: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the rows of manifest."""
    siblings = F.transform("path", lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit(""))))
    folded_root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


ORACLE_SQL = rf"""
WITH RECURSIVE
c AS (SELECT *, xor(list_reduce(flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM documents),
l AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM c),
d AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM d
      UNION ALL
      SELECT lang, level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, h FROM s
      UNION ALL
      SELECT level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2),
p AS (SELECT d.r, x.level, CASE WHEN y.h IS NULL THEN '-' WHEN y.pos < x.pos THEN 'L' || y.h ELSE 'R' || y.h END AS step
      FROM d JOIN t x ON x.lang IS NOT DISTINCT FROM d.lang AND x.n > 1 AND x.pos = d.pos >> x.level LEFT JOIN t y ON y.lang IS NOT DISTINCT FROM x.lang AND y.level = x.level AND y.pos = xor(x.pos, 1)
      UNION ALL
      SELECT d.r, 1000 + x.level, CASE WHEN y.h IS NULL THEN '-' WHEN y.pos < x.pos THEN 'L' || y.h ELSE 'R' || y.h END
      FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN u x ON x.n > 1 AND x.pos = s.pos >> x.level LEFT JOIN u y ON y.level = x.level AND y.pos = xor(x.pos, 1)),
q AS (SELECT r, list(step ORDER BY level) AS steps FROM p GROUP BY r),
f AS (SELECT d.doc_id, d.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root,
             sha256(coalesce(array_to_string(list_transform(q.steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
             list_reduce(coalesce(q.steps, []), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), coalesce(d.tampered, d.leaf)) AS folded_root
      FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang LEFT JOIN q ON q.r = d.r)
SELECT *, folded_root = root AS verified FROM f
"""
