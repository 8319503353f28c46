"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.session import cut


def _least(pairs: DataFrame, key: str, value: str, rows: int) -> DataFrame:
    """(key, m, n): the smallest value of each key, and its rows."""
    return cut(pairs.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n")), "least", rows)


def _state(pairs: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are all known: each node that has an edge down has one only, to a node that has none."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(pairs.select("b", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    size, open_ = found.agg(F.sum("down"), F.max((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()
    return size or 0, not open_


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b), of any one type that has an order: the component is its smallest node.

    Alternating stars: every node links its larger neighbours to the smallest node it knows, then its smaller ones, until
    only stars are left; each round works on at most as many edges as there are, and is written in as many files as they fill. A hot node's edges are dealt in parts
    where they meet its smallest neighbour. Rounds grow with the logarithm of the longest path; stars, and no edges, take none.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    size, done = _state(pairs)
    while not done:
        # Large star: neighbours above a node go to the smallest of it and its neighbours.
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = _least(both, "u", "v", 2 * size)
        large = join_hot(both.filter("v > u"), least.select("u", F.least("u", "m").alias("m")), ["u"], hot_keys(least, ["u"]), ["v"])
        pairs = cut(large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges", size)
        # Small star: a node and those below it go to the smallest of them.
        lowest = _least(pairs, "a", "b", size)
        joined = join_hot(pairs, lowest.select("a", "m"), ["a"], hot_keys(lowest, ["a"]), ["b"])
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        pairs = cut(small.distinct(), "edges", 2 * size)
        size, done = _state(pairs)
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
