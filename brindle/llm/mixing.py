"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.running import global_rank, running_total
from brindle.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def n_words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, size).

    Sources by code point, null last, weigh weights[0], weights[1], ... again and again, and share `share` times all words. A target above
    epochs times its source's size stops there; its excess goes to the others by weight until no target is above.
    Each turn of the loop reads three sums; the capped set only grows.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("_cap")), "sources")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        capped = F.col("_cap") <= F.lit(level) * F.col("weight")
        caps, free = rows.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            break
        now = (total - float(caps or 0)) / float(free)
        if now <= level:
            break
        level = now
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Within its source every document is offered once per epoch in a shuffled order, md5(seed, epoch, id). Its virtual
    finish time is the source's words up to and with it divided by the source's target; all offers are sorted by that
    time over range partitions, and offers are taken while the words so far are within the sum of the targets. Running
    totals come from partition sums (brindle.functions.running), so a hot source is spread over many tasks. A document is
    taken whole, up to `epochs` times; taken counts its words each time. A null text, or one without words, has size 0 and
    is never taken; a null source is a source of its own, last in order. Rows that repeat an id are rows of their own.
    Equal runs agree, since every order ends in id and size. An empty table gives an empty result.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.monotonically_increasing_id().alias("_row")), "sized")
    targets = cut(source_targets(sized, weights, share, epochs), "targets")
    offers = (
        sized.filter("size > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("_epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    )
    order = [F.col("source").asc_nulls_last(), F.col("_epoch"), F.col("_key"), F.col("size"), F.col("_row")]
    summed = running_total(offers, order, "size", "_upto")
    # What the sources before this one offer, to turn the global running total into one of the source.
    start = running_total(targets, [F.col("source").asc_nulls_last()], "source_size", "_through").select(
        F.col("source").alias("_source"), "target", ((F.col("_through") - F.col("source_size")) * epochs).alias("_start")
    )
    timed = summed.join(start, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_row", "source", "_epoch", "_key", "size", ((F.col("_upto") - F.col("_start")) / F.col("target")).alias("_finish")
    )
    budget = float(targets.agg(F.sum("target")).first()[0] or 0)
    queued = running_total(timed, [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_epoch"), F.col("_key"), F.col("size"), F.col("_row")], "size", "_words")
    taken = queued.filter(F.col("_words") <= F.lit(budget)).groupBy("_row").agg(F.sum("size").alias("_taken"))
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sized.join(taken, "_row", "left")
        .join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce(F.col("_taken"), F.lit(0)).cast("long").alias("taken"), "source", "_row")
    )


ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS c, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS f
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM (SELECT CAST(cap AS DOUBLE) / weight AS ratio, (CAST((SELECT sum(source_size) FROM w) AS DOUBLE) * 1.5 - CAST(c AS DOUBLE)) / CAST(f AS DOUBLE) AS level FROM r) WHERE level <= ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM w),
o AS (SELECT doc_id, s.source, size, e.epoch, target, md5('mix:' || e.epoch || ':' || doc_id) AS k
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS epoch) e WHERE size > 0),
v AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY epoch, k, size) AS DOUBLE) / target AS finish FROM o),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, k, size ROWS UNBOUNDED PRECEDING) AS words FROM v),
x AS (SELECT doc_id, sum(size) AS taken FROM q WHERE words <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON s.doc_id = x.doc_id
"""
