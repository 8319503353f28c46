"""Ranked lexical search: the best documents of every item, by range-maximum tables over posting lists.

1. Items are split into blocks of a bounded number of terms; a block is searched at once, over all documents.
2. A task reads its documents once and writes shards: for each term of the block, the places of the documents that hold it and how
   often. How many documents and terms there are, and how many documents hold a term, are sums over all shards.
3. A shard's posting lists get a sparse table each: the place of the largest impact in every run of 2^k postings. For an item, an interval of documents
   is bounded by the sum, over its terms, of the largest impact inside. The intervals with the highest bounds are taken first, and each is split
   at the document of its largest impact, which gets its exact score; an interval whose bound can't reach the last of the best so far is left.
   A task hands what it has found from shard to shard, so that the last of the best rises.
4. The best of all tasks meet in two rounds of ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.running import running_total
from brindle.llm.memory import tidy
from brindle.session import cut

BEST = 20
#: Terms of items that are searched together: what every task knows of them.
TERMS_A_BLOCK = 200_000
#: Postings and documents of a shard, unless one document has more.
POSTINGS_A_SHARD, DOCS_A_SHARD = 1 << 19, (1 << 16) - 1
#: Intervals of an item that are split in one step.
TOGETHER = 64
_SALTS = 64
#: A-Z become a-z; 0-9, a-z and all bytes of other characters stay; the rest ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHARD = "n_docs long, n_terms long, ids binary, known binary, sizes binary, terms binary, counts binary, places binary, times binary"
_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


class _Shard:
    """Collects documents until they are a shard's worth."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = self.n = 0
        self.docs: list[tuple[int | None, int]] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, words: list[bytes], numbers: dict[bytes, int]) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = Counter(filter(numbers.__contains__, words))
        if found:
            self.docs.append((doc_id, len(words)))
            self.found.append((np.array([numbers[t] for t in found], np.int32), np.array(list(found.values()), np.uint32)))
            self.n += len(found)

    def full(self) -> bool:
        return self.n >= POSTINGS_A_SHARD or len(self.docs) >= DOCS_A_SHARD

    def row(self) -> pa.RecordBatch:
        """Documents by id, those without one last; postings by term, then by document."""
        docs = sorted(range(len(self.docs)), key=lambda k: (self.docs[k][0] is None, self.docs[k][0] or 0))
        found = [self.found[k] for k in docs]
        place = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(t) for t, _ in found])
        term = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int32)
        times = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.uint32)
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        ids = np.array([self.docs[k][0] or 0 for k in docs], np.int64)
        known = np.array([self.docs[k][0] is not None for k in docs], np.bool_)
        sizes = np.array([self.docs[k][1] for k in docs], np.int64)
        arrays = [ids, known, sizes, terms.astype(np.int32), counts.astype(np.int32), place[order], times[order]]
        return pa.RecordBatch.from_arrays([pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], _NAMES)


def shards(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting lists of the terms in numbers (term: its number), a row for each shard of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, terms_of(text.as_py() or b""), numbers)
                if shard.full():
                    yield shard.row()
                    shard = _Shard()
        if shard.n_docs:
            yield shard.row()

    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidy(run), _SHARD), "shards")


def holders(index: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = (np.concatenate([np.frombuffer(x, np.int32) for x in batch.column(c).to_pylist()] or [np.zeros(0, np.int32)]) for c in (0, 1))
            total = np.bincount(terms, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Postings:
    """A shard's posting lists with impacts, and their sparse tables: tables[k, i] is the place of the first largest impact among 2^k postings from i."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.known, sizes = read("ids", np.int64), read("known", np.bool_), read("sizes", np.int64)
        terms, counts = read("terms", np.int32), read("counts", np.int32)
        place, times = read("places", np.uint16), read("times", np.uint32).astype(np.int64)
        self.place = place.astype(np.int64)
        m = 100 - 25 + np.array([25 * s * n_docs // n_terms for s in sizes.tolist()], np.int64)
        self.impact = ((1_000_000_000 * times) // (1000 * times + 12 * m[self.place])).astype(np.int32)
        ends = np.cumsum(counts)
        self.lists = dict(zip(terms.tolist(), zip((ends - counts).tolist(), ends.tolist())))
        self.keys = np.repeat(terms.astype(np.int64), counts) << 16 | self.place
        longest = int(counts.max()) if len(counts) else 1
        self.log = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.log[n] = self.log[n >> 1] + 1
        rows = int(self.log[longest]) + 1
        self.tables = np.empty((rows, len(self.place)), np.int32)
        if len(self.place):
            self.tables[0] = np.arange(len(self.place))
        for k in range(1, rows):
            half, below = 1 << (k - 1), self.tables[k - 1]
            left, right = below[:-half], below[half:]
            self.tables[k, : len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.tables[k, len(left) :] = below[len(left) :]

    def largest(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest impact of each run [start, stop) stands, and what it is; 0 for an empty run."""
        n = stop - start
        some = n > 0
        k = self.log[np.where(some, n, 1)]
        a, b = self.tables[k, np.where(some, start, 0)], self.tables[k, np.where(some, stop - (1 << k), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return at, np.where(some, self.impact[at], 0)


class Best:
    """The best documents of an item so far: the highest score first, then the smallest id, those without an id last."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        on = score >= (self.score[-1] if len(self.score) == self.most else 1)
        if not on.any():
            return
        score, doc, known = (np.concatenate([x, y[on]]) for x, y in ((self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, ~known, -score))[: self.most]
        self.score, self.doc, self.known = score[order], doc[order], known[order]

    def open(self, bound: np.ndarray, first: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which intervals, of this bound and this first document, may still hold one of the best."""
        if len(self.score) < self.most:
            return bound > 0
        last, doc = self.score[-1], self.doc[-1]
        # At the bound itself only a smaller id than the last one's helps; ids ascend inside an interval.
        earlier = known & (first < doc) if self.known[-1] else known
        return (bound > last) | ((bound == last) & earlier)


def search(shard: Postings, terms: list[int], weights: list[int], best: Best, together: int = TOGETHER) -> int:
    """Adds to best what the shard has for an item of these terms and weights (repeats counted in). Returns how many documents got a score."""
    on = [(shard.lists[t], t, w) for t, w in zip(terms, weights) if t in shard.lists and w > 0]
    if not on:
        return 0
    weight = np.array([w for _, _, w in on], np.int64)
    key = np.array([t for _, t, _ in on], np.int64) << 16

    def bounded(first: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        at, impact = shard.largest(start, stop)
        worth = impact * weight
        bound = worth.sum(axis=1)
        split = shard.place[np.take_along_axis(at, worth.argmax(axis=1)[:, None], 1)[:, 0]]
        stays = best.open(bound, shard.ids[np.minimum(first, len(shard.ids) - 1)], shard.known[np.minimum(first, len(shard.ids) - 1)])
        return tuple(x[stays] for x in (bound, split, first, start, stop))

    bound, split, first, start, stop = bounded(np.zeros(1, np.int64), np.array([[a for (a, _), _, _ in on]]), np.array([[b for (_, b), _, _ in on]]))
    scored = 0
    while len(bound):
        if len(bound) > together:
            chosen = np.zeros(len(bound), np.bool_)
            chosen[np.argpartition(-bound, together)[:together]] = True
        else:
            chosen = np.ones(len(bound), np.bool_)
        doc, a, b = split[chosen], start[chosen], stop[chosen]
        target = key + doc[:, None]
        at = np.searchsorted(shard.keys, target)
        holds = shard.keys[np.minimum(at, len(shard.keys) - 1)] == target
        score = (np.where(holds, shard.impact[np.minimum(at, len(shard.keys) - 1)], 0) * weight).sum(axis=1)
        best.add(score, shard.ids[doc], shard.known[doc])
        scored += len(doc)
        new = bounded(np.concatenate([first[chosen], doc + 1]), np.concatenate([a, at + holds]), np.concatenate([at, b]))
        rest = ~chosen
        rest[rest] = best.open(bound[rest], shard.ids[first[rest]], shard.known[first[rest]])
        bound, split, first, start, stop = (np.concatenate([x[rest], y]) for x, y in zip((bound, split, first, start, stop), new))
    return scored


def _found(index: DataFrame, block: list[tuple[int, int | None, list[int], list[int]]], n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best of each task, for every item of the block (number, id, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in block]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Postings({c: batch.column(c)[k].as_py() for c in _NAMES[2:]}, n_docs, n_terms)
                for (_, _, terms, weights), found in zip(block, best):
                    search(shard, terms, weights, found)
        n = [len(b.score) for b in best]
        doc = np.concatenate([b.doc for b in best])
        known = np.concatenate([b.known for b in best])
        item, item_id = (pa.array([v for x, m in zip(block, n) for v in [x[c]] * m], pa.int64()) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([item, item_id, pa.array(doc, mask=~known), pa.array(np.concatenate([b.score for b in best]))], ["item", "item_id", "doc_id", "score"])

    return index.select(_NAMES[2:]).mapInArrow(tidy(run), "item long, item_id long, doc_id long, score long")


def _items(items: DataFrame, terms_a_block: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms, times, block) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t.as_py() or b"")) for t in batch.column(1)]
            arrays = [pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64())), pa.array([len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["item_id", "terms", "times", "n"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "item_id long, terms array<binary>, times array<long>, n long")
    rows = cut(rows.filter("n > 0"), "items").withColumn("item", F.monotonically_increasing_id())
    return running_total(rows, [F.col("item_id"), F.col("item")], "n", "_upto").withColumn("block", F.floor((F.col("_upto") - F.col("n")) / terms_a_block))


def ranked_search(docs: DataFrame, items: DataFrame, most: int = BEST, terms_a_block: int = TERMS_A_BLOCK, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for every row of items the `most` best rows of docs with a score above 0, or all if they are fewer.

    Terms are the maximal runs of 0-9, A-Z, a-z and of characters beyond ASCII, A-Z in lower case, of the whole text; a null text has none. N, L, df, n
    and tf as usual; a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), a document's length m = 75 + 25nN div L, and its score is the sum of
    w * (1000000000tf div (1000tf + 12m)) over the item's terms, repeats included. Equal scores rank by id, rows without an id last. Items that
    repeat an id are ranked one by one, as are documents that do. An item without terms, or whose terms no document has, gives no rows; so do empty
    tables. Other columns are ignored. Documents are read once for each block of items (terms_a_block terms, or one longer item).
    """
    spark = docs.sparkSession
    told = cut(_items(items, terms_a_block, item_col, text_col), "blocks")
    blocks = told.agg(F.max("block")).first()[0]
    results = []
    for b in range(0 if blocks is None else int(blocks) + 1):
        # At most terms_a_block terms, or one item's.
        block = told.filter(F.col("block") == b).select("item", "item_id", "terms", "times").collect()
        numbers = {t: k for k, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
        index = shards(docs, numbers, id_col, text_col)
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        df = {r["term"]: r["n"] for r in holders(index).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = []
        for r in block:
            known = [(numbers[bytes(t)], n) for t, n in zip(r["terms"], r["times"]) if numbers[bytes(t)] in weight]
            asked.append((r["item"], r["item_id"], [t for t, _ in known], [weight[t] * n for t, n in known]))
        results.append(_found(index, asked, n_docs, n_terms, most))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    found = cut(found, "found")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "_salt"], ["item"]):
        found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SALTS))) if "_salt" in keys else found
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
