"""SimHash near-dedup: fingerprints in Gray order under a hierarchical index of shared bit patterns.

1. Every text becomes a 64-bit fingerprint; equal fingerprints are one class.
2. Classes are sorted by Gray rank (the place of a fingerprint in the reflected Gray sequence) over range partitions. Neighbours in
   that order share most of their bits: each partition is a piece, and the bits that all its fingerprints share are a masked
   pattern. The patterns of all pieces, factored once more, are the upper nodes; there are at most MAX_PIECES of them.
3. A fingerprint walks the upper nodes, adding up the bits in which it differs from the patterns; a whole piece, or a whole group
   of pieces, is passed by when the sum is above the limit. It is sent to the later pieces that are left, packed with others.
4. A piece builds the same index over its own fingerprints, down to single ones, and what it is sent walks it. A piece emits one edge for
   each fingerprint that is linked, not all pairs; connected components of the edges are the classes of near copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.llm.components import connected_components
from brindle.llm.memory import tidy
from brindle.session import cut

WIDTH = 3
#: Two fingerprints link if they differ in this many bits at most.
DISTANCE = 2
SEED = 42
#: Fingerprints a piece should hold, and the most pieces: the upper nodes that every task knows.
A_PIECE = 20_000
MAX_PIECES = 1 << 14
#: Nodes under a node of the index.
FANOUT = 8
#: Queries that walk the index together, and pairs of query and node after which they are halved.
_TOGETHER, _PAIRS = 512, 1 << 21
#: Fingerprints a task holds before it sends them; bytes of text, and shingles, that are hashed at once.
_HELD, _CHUNK, _AT_ONCE = 1 << 19, 1 << 20, 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about _CHUNK bytes of it at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _CHUNK) if at + _CHUNK < len(text) else None
        end = space.start() if space else len(text)
        yield text[at:end].lower().split()  # bytes: only A-Z change, and only ASCII white space ends a word
        at = end


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit k is set if more than half of the hashes of the text's word shingles, repeats included, have it; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []

    def count(words: list[bytes], spans: int, take: int) -> None:
        nonlocal total
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        for k in range(0, spans, _AT_ONCE):
            a, b = starts[k : min(k + _AT_ONCE, spans)].tolist(), ends[k + take - 1 : min(k + _AT_ONCE, spans) + take - 1].tolist()
            hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
            ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += spans

    for words in _words(text):
        held += words
        if len(held) >= width:
            count(held, len(held) - width + 1, width)
            held = held[len(held) - width + 1 :]
    if not total and held:
        count(held, 1, len(held))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; a null text is empty. fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of fp in the reflected Gray sequence, as a signed number of the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _grown(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... n[i] of them, one after the other."""
    stops = np.cumsum(n)
    return np.repeat(starts - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)


class GrayIndex:
    """Bit patterns (mask, value) in Gray order under nodes that hold what FANOUT patterns below have in common.

    A node keeps only the bits that its parent does not have, so that the differences on the way down add up to those with the whole pattern.
    """

    def __init__(self, masks: np.ndarray, values: np.ndarray) -> None:
        levels = [(masks, values & masks)]
        while len(levels[-1][0]) > FANOUT:
            mask, value = levels[-1]
            starts = np.arange(0, len(mask), FANOUT)
            every, some = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(every ^ some)
            levels.append((shared, every & shared))
        self.levels = []
        for k, (mask, value) in enumerate(levels):
            if k + 1 < len(levels):
                mask = mask & ~np.repeat(levels[k + 1][0], FANOUT)[: len(mask)]
            self.levels.append((mask, value & mask))
        self.levels.reverse()

    def _walk(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (query, pattern) that differ in `most` bits at most, by query; None if they become too many to hold at once."""
        n = len(self.levels[0][0])
        who, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        so_far = np.zeros(len(who), np.uint8)
        for k, (mask, value) in enumerate(self.levels):
            if k:
                first = node * FANOUT
                n = np.minimum(FANOUT, len(mask) - first)
                if len(queries) > 1 and n.sum() > _PAIRS:
                    return None
                who, so_far, node = np.repeat(who, n), np.repeat(so_far, n), _grown(first, n)
            so_far = so_far + np.bitwise_count((queries[who] ^ value[node]) & mask[node])
            near = so_far <= most
            who, node, so_far = who[near], node[near], so_far[near]
        return who, node

    def near(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (query, pattern) within `most` bits, some queries at a time."""
        todo = [(k, min(k + _TOGETHER, len(queries))) for k in range(0, len(queries), _TOGETHER)][::-1]
        while todo:
            a, b = todo.pop()
            found = self._walk(queries[a:b], most)
            if found is None:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            else:
                yield found[0] + a, found[1]


class _Piece:
    """The fingerprints of a piece, and which of them what has come so far holds together."""

    def __init__(self, own: np.ndarray, most: int) -> None:
        self.own, self.most = own, most
        self.index = GrayIndex(np.full(len(own), _ALL), own)
        self.parent = np.arange(len(own))

    def _root(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while True:
            above = self.parent[up]
            if np.array_equal(above, up):
                return up
            up = above

    def meet(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, one fingerprint of the piece that is near it) for each query that has any; those near one query become one class."""
        near_q, near_f = [], []
        for who, which in self.index.near(queries, self.most):
            if not len(who):
                continue
            at = np.flatnonzero(np.diff(who, prepend=-1))
            first = np.repeat(which[at], np.diff(np.append(at, len(who))))
            near_q.append(queries[who[at]])
            near_f.append(self.own[which[at]])
            a, b = first, which
            while True:
                a, b = self._root(a), self._root(b)
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                # A larger root goes under a smaller one; of several that it meets, any will do, the others are met in the next turn.
                self.parent[np.maximum(a, b)] = np.minimum(a, b)
        none = np.zeros(0, np.uint64)
        return (np.concatenate(near_q), np.concatenate(near_f)) if near_q else (none, none)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, the first of its class) for each that is not the first itself."""
        root = self._root(np.arange(len(self.own)))
        rest = np.flatnonzero(root != np.arange(len(self.own)))
        return self.own[rest], self.own[root[rest]]


def _sent(placed: DataFrame, upper: GrayIndex, pieces: np.ndarray, most: int) -> DataFrame:
    """(piece, own, fps): packed fingerprints of a piece, and those of earlier pieces that may be near some of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[np.ndarray]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([own for _, own in keys], pa.bool_()), pa.array([np.concatenate(held[k]).tobytes() for k in keys], pa.binary())], ["piece", "own", "fps"])

        for batch in batches:
            piece, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for p in np.unique(piece).tolist():
                held.setdefault((p, True), []).append(fp[piece == p])
            n += len(fp)
            for who, which in upper.near(fp, most):
                later = pieces[which] > piece[who]
                who, to = who[later], pieces[which[later]]
                order = np.argsort(to, kind="stable")
                who, to = who[order], to[order]
                at = np.flatnonzero(np.diff(to, prepend=-1))
                for p, x in zip(to[at].tolist(), np.split(fp[who], at[1:])):
                    held.setdefault((p, False), []).append(x)
                n += len(who)
                if n >= _HELD:
                    yield flush()
                    held.clear()
                    n = 0
        if held:
            yield flush()

    return placed.select("piece", "fp").mapInArrow(tidy(run), "piece int, own boolean, fps binary")


def _edges(sent: DataFrame, parts: int, most: int) -> DataFrame:
    """(a, b): edges that hold all near fingerprints together, of rows (piece, own, fps). A piece's own fingerprints come first, then what it is sent streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, piece = None, [], None

        def made() -> _Piece:
            fps = np.concatenate(own)
            done = _Piece(fps[np.argsort(_rank(fps))], most)
            done.meet(done.own)
            return done

        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def ended() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield rows(*(piece or made()).classes())

        for batch in batches:
            for p, is_own, fps in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if p != now:
                    yield from ended()
                    now, own, piece = p, [], None
                fps = np.frombuffer(fps, np.uint64)
                if is_own:
                    own.append(fps)
                    continue
                if piece is None:
                    piece = made()
                yield rows(*piece.meet(fps))
        yield from ended()

    return sent.repartition(parts, "piece").sortWithinPartitions("piece", F.col("own").desc()).mapInArrow(tidy(run), "a long, b long")


def _rank(fp: np.ndarray) -> np.ndarray:
    """gray_rank of numbers."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return fp


def near_classes(fps: DataFrame, most: int = DISTANCE, a_piece: int = A_PIECE, max_pieces: int = MAX_PIECES) -> DataFrame:
    """(fp, component) of distinct fingerprints (fp) that are linked with any other: component is the smallest number reachable.

    Broadcast are the patterns of the pieces, max_pieces at most; each task sends a fingerprint to the pieces whose shared bits differ from it in `most` at most.
    """
    spark = fps.sparkSession
    parts = min(max_pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(fps.count() / a_piece)))
    placed = fps.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select(F.spark_partition_id().alias("piece"), "fp")
    placed = cut(placed, "gray")
    shared = placed.groupBy("piece").agg(F.bit_and("fp"), F.bit_or("fp")).orderBy("piece").limit(max_pieces + 1).collect()
    every, some = (np.array([r[k] for r in shared], np.int64).view(np.uint64) for k in (1, 2))
    upper = GrayIndex(~(every ^ some), every)
    sent = _sent(placed, upper, np.array([r[0] for r in shared], np.int64), most)
    return connected_components(_edges(sent, parts, most)).select(F.col("node").alias("fp"), "component")


def simhash(docs: DataFrame, width: int = WIDTH, most: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", a_piece: int = A_PIECE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row of docs.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, shingles are `width` words joined by a space, repeats included (with fewer words the
    whole sequence), hashed by XXH64 with seed 42. A text without words, or null, has fingerprint 0 and links like any other.
    Fingerprints link when they differ in `most` bits at most; component_id is the smallest id reachable, the row's own included, and null where
    no row of the component has an id. Rows that repeat an id are rows of their own; other columns are ignored; an empty table gives an empty
    result. Texts are hashed a piece at a time, whatever their length.
    """
    rows = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = near_classes(distinct.select("fp"), most, a_piece)
    named = cut(distinct.join(found.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    of_fp = join_hot(named.select("fp", "component"), ids.drop("n"), ["component"], hot_keys(ids, ["component"]), ["fp"])
    told = join_hot(rows, of_fp.select("fp", "component_id"), ["fp"], hot_keys(named, ["fp"]), ["doc_id"])
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
