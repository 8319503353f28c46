"""A counterfactual-regularised toxicity classifier over the words of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brindle.llm.memory import tidy

# Identity terms by group. A term is swapped for the next ones of its group.
IDENTITY_GROUPS = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("female", "male", "nonbinary"),
    ("girl", "boy", "child"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("immigrant", "refugee", "citizen", "native"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("blind", "deaf", "disabled", "abled"),
    ("old", "young", "elderly"),
)

#: Ends the name of a feature that two or more chunks of a text have.
AGAIN = "+"
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)
#: Chunks that a reader remembers, those of at most _LONG characters; features that a task counts before it sends them on. They bound memory, not results.
_REMEMBERED, _LONG, _COUNTED = 60_000, 40, 100_000


@dataclass(frozen=True)
class Settings:
    """max_rows: labelled rows fitted, at most half of each class, the smallest hashes of their ids first; the only bound. swaps: variants of
    each text that names a group. min_g2: G squared of a feature, the quantile of chi squared that one of 1,000 features reaches by chance at
    any number of rows and shares of the classes. l2, counterfactual: weights of the penalties."""

    max_rows: int = 16_000
    swaps: int = 2
    min_g2: float = 10.83
    l2: float = 1e-6
    counterfactual: float = 5.0
    threshold: float = 0.7
    steps: int = 1000


@dataclass
class Model:
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7


def swap_table(k: int) -> dict[str, str]:
    """Each identity term and the k-th after it in its group."""
    return {t: group[(i + k) % len(group)] for group in IDENTITY_GROUPS for i, t in enumerate(group)}


def word_features(word: str) -> list[str]:
    """The word and its beginnings, marked so that a beginning is not taken for a word."""
    return [word, *(word[:k] + "~" for k in _PREFIXES if len(word) > k)]


def chunk_words(chunk: str) -> list[str]:
    return _WORD.findall(chunk.lower())


class _Reader:
    """Features of texts that are in a given table, remembered by chunk."""

    def __init__(self, index: dict[str, int] | None, swap: dict[str, str] | None = None):
        self.index, self.swap, self.known = index, swap or {}, {}

    def features(self, text: str) -> set:
        """Features of the text's words, and for those of two different chunks or more the feature marked with AGAIN."""
        out: set = set()
        again: set = set()
        known = self.known
        for c in set(text.split()):
            f = known.get(c)
            if f is None:
                f = self._of(c)
                if len(c) <= _LONG:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    known[c] = f
            for x in f:
                if x in out:
                    again.add(x)
                else:
                    out.add(x)
        if self.index is None:
            return out | {x + AGAIN for x in again}
        get = self.index.get
        return {k for x in out if (k := get(x)) is not None} | {k for x in again if (k := get(x + AGAIN)) is not None}

    def _of(self, chunk: str) -> tuple[str, ...]:
        names = {x for w in chunk_words(chunk) for x in word_features(self.swap.get(w, w))}
        return tuple(names if self.index is None else {x for x in names if x in self.index or x + AGAIN in self.index})


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, toxic, weight): the bounded sample. Weight: labelled rows of the class for each row taken."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = settings.max_rows // 2
    ranked = marked.withColumn("_h", F.xxhash64(F.lit("fit"), "doc_id"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for c in (0, 1):
        n = sizes.get(c, 0)
        part = ranked.filter(F.col("toxic") == c).orderBy("_h", "doc_id").limit(half).select("doc_id", "toxic", F.lit(n / max(1, min(n, half))).alias("weight"))
        picked = part if picked is None else picked.unionByName(part)
    # At most max_rows rows of three numbers.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A logistic regression on the presence of words and word beginnings.

    Features are those that sampled toxic rows have more often than clean ones, the most telling first (G squared, more than min_g2). It
    is taken of every feature; a feature that no clean row has is told by its toxic rows alone.
    Every sampled text that names a group of IDENTITY_GROUPS is also read with its terms swapped, and the squared
    change of its log odds is penalised, so that the mention of a group alone does not move the score.
    Without labelled rows of both classes the model has no features and scores every text as its bias.
    """
    sample = labelled_sample(docs, labels, settings).select("doc_id", "text", "toxic", "weight").persist()

    def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = _Reader(None), {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in reader.features(t or ""):
                    seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > _COUNTED:
                    yield _counts_batch(seen)
                    seen = {}
        yield _counts_batch(seen)

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    identity = sorted({x for g in IDENTITY_GROUPS for t in g for x in word_features(t)})
    # Every feature of the sample is counted and told; the telling ones, of at most max_rows texts, are collected.
    counts = sample.select("text", "toxic").mapInArrow(tidy(class_counts), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    names = _telling(counts, sizes, identity, settings)
    index = {n: i for i, n in enumerate(names)}
    swaps = [swap_table(k) for k in range(1, settings.swaps + 1)]
    terms = frozenset(swaps[0]) if swaps else frozenset()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, swapped = _Reader(index), [_Reader(index, s) for s in swaps]
        for b in batches:
            for i, t, y, w in zip(*(b.column(k).to_pylist() for k in range(4))):
                t = t or ""
                out = [plain.features(t)]
                if terms and not terms.isdisjoint(chunk_words(t)):
                    out += [r.features(t) for r in swapped]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([y], pa.int32()), pa.array([w]), pa.array([[sorted(f) for f in out]], pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "weight", "variants"])

    # Bounded: max_rows rows, (1 + swaps) variants of each, of the telling features. A row stands for itself, also where its id repeats.
    got = sorted((tuple(r) for r in sample.mapInArrow(tidy(rows), "doc_id long, toxic int, weight double, variants array<array<int>>").collect()), key=lambda r: (r[0], r[1], r[3]))
    sample.unpersist()
    return _fitted(got, names, settings)


def _counts_batch(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n for _, n in seen.values()], pa.int64()), pa.array([n for n, _ in seen.values()], pa.int64())], ["f", "pos", "neg"])


def _g2(pos: Column, neg: Column, toxic: int, clean: int) -> Column:
    """Log-likelihood ratio (G squared) of a feature's presence against the class."""
    seen, every = pos + neg, max(1, toxic + clean)
    part = lambda n, rows, size: F.when(n > 0, n * F.log(n * every / (rows * size))).otherwise(0.0)
    return 2 * (part(pos, seen, toxic) + part(neg, seen, clean) + part(toxic - pos, every - seen, toxic) + part(clean - neg, every - seen, clean))


def _telling(counts: DataFrame, sizes: dict[int, int], identity: list[str], settings: Settings) -> list[str]:
    """Of counts (f, pos, neg) the features that toxic rows have more often, with more than the least G squared, and the groups' terms that are in three rows or more."""
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    named = F.col("f").isin(identity) & (F.col("pos") + F.col("neg") > 2)
    told = counts.select("f", named.alias("named"), (F.col("pos") * clean > F.col("neg") * toxic).alias("more"), _g2(F.col("pos"), F.col("neg"), toxic, clean).alias("g2"))
    told = told.filter(F.col("named") | F.col("more") & (F.col("g2") > settings.min_g2)).orderBy(F.col("named").desc(), F.col("g2").desc(), "f").collect()
    return sorted(r["f"] for r in told)


def _fitted(rows: Iterable[tuple], names: list[str], settings: Settings) -> Model:
    """rows: (id, label, weight, variants), the first variant as it stands, the others with the groups' terms swapped."""
    rows = list(rows)
    y = np.array([r[1] for r in rows], float)
    if not rows or y.min() == y.max():
        return Model(threshold=settings.threshold)
    weight = np.array([r[2] for r in rows], float)
    weight /= weight.sum()
    at = np.repeat(np.arange(len(rows)), [len(r[3][0]) for r in rows])
    cols = np.concatenate([np.array(r[3][0], np.int64) for r in rows])
    n, k = len(rows), len(names)
    # Changes of the features under each swap, as signed entries.
    d_at, d_col, d_sign, owner = [], [], [], []
    for i, (_, _, _, (plain, *swapped)) in enumerate(rows):
        before = set(plain)
        for after in map(set, swapped):
            changed = [(c, s) for cs, s in ((after - before, 1.0), (before - after, -1.0)) for c in sorted(cs)]
            if changed:
                d_at += [len(owner)] * len(changed)
                d_col += [c for c, _ in changed]
                d_sign += [s for _, s in changed]
                owner.append(i)
    d_at, d_col, d_sign = np.array(d_at, np.int64), np.array(d_col, np.int64), np.array(d_sign, float)
    share = weight[np.array(owner, np.int64)] if owner else np.zeros(0)
    share = share / max(share.sum(), 1e-12)
    w, b, m, v = np.zeros(k), float(np.log((weight @ y) / (weight @ (1 - y)))), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, settings.steps + 1):
        error = weight * (1 / (1 + np.exp(-(np.bincount(at, w[cols], n) + b))) - y)
        grad = np.bincount(cols, error[at], k) + settings.l2 * w
        if len(owner):
            change = np.bincount(d_at, w[d_col] * d_sign, len(owner)) * share
            grad += 2 * settings.counterfactual * np.bincount(d_col, change[d_at] * d_sign, k)
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (1 - step / (settings.steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:k], b - move[k]
    return Model(b, {x: float(v) for x, v in zip(names, w)}, settings.threshold)


def score_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all its columns and _score; only the text is read for it. A column of that name gives way."""
    names = sorted(model.weights)
    weights, bias = np.array([model.weights[n] for n in names]), model.bias
    index = {n: i for i, n in enumerate(names)}
    docs = docs.drop("_score")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for b in batches:
            z = np.array([bias + weights[sorted(f)].sum() if (f := reader.features(t or "")) else bias for t in b.column(place).to_pylist()], float)
            yield b.append_column("_score", pa.array(1 / (1 + np.exp(-z))))

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text; other columns are no input.

    A null or empty text has no features and gets the score of the bias. Repeated rows and null ids (held_out false) are kept; an
    empty table gives an empty result; other columns, of any name, are ignored. One pass, no shuffle.
    """
    scored = score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= model.threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """fit on the labelled rows that are not held out, then score every row."""
    return score(docs, fit(docs, labels, settings))
