"""N-gram Jaccard join: sets of word shingles in a prefix tree, all links at or above a similarity, as connected components.

1. Every text becomes the set of its distinct shingles; texts with equal sets are one class, named by 128 bits of its set.
2. A class can only link to another one if at least `share` of its shingles stand in other texts. Sorted runs of
   shingles are exchanged, packed, by ranges of their hash; a shingle that a task holds more than once is sent once.
   What comes back is how many shingles of each class others have. Classes below the share have no links.
3. Of the rest, rarest shingles first, only a prefix can be free of common shingles (n - ceil(share * n) + 1 of n):
   classes that share a shingle of their prefixes are one cluster.
4. Each cluster's sets, commonest shingle first, go into a prefix tree; every set walks it level by level, a branch's
   overlap is counted once for all sets below it, and branches are cut when what remains of both lengths can't reach
   the overlap needed. A large cluster is dealt in pieces. Each piece is linked in itself and with the first piece, which makes most groups one; then one set of each
   linked group meets those of other pieces, and last the sets outside their cluster's largest group meet the pieces that hold one of their prefix shingles
   where enough of both sets is left for a link: two sets of one group need no link, so that no pair of pieces meets whole. Phases without anything to do are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.hot import hot_keys, join_hot
from brindle.llm.components import connected_components
from brindle.llm.hashing import forget, mix, shingles
from brindle.llm.memory import tidy
from brindle.session import cut

WIDTH = 5
#: Similarity as a fraction of whole numbers: 80 / 100.
PERCENT = 80
#: Shingles a task of step 2, and a piece of a cluster in step 4, should hold about.
SHINGLES_A_TASK = 1_500_000
SHINGLES_A_PIECE = 30_000
#: Bytes of text hashed at once, unless one text is longer.
_CHUNK = 1 << 20


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Few rows at a time: rows (id, text) and their sets."""
    for k in range(0, batch.num_rows, 500):
        rows = batch.slice(k, 500)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column(1).to_pylist()]
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= _CHUNK):
                n += len(texts[j]) + 1
                j += 1
            yield rows.slice(i, j - i), shingles(texts[i:j], width)
            i = j


def _name(s: np.ndarray) -> bytes:
    """128 bits of a set and its size, the same in any order."""
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0x14057B7EF767814F))
    return np.array([np.sum(a, dtype=np.uint64), np.bitwise_xor.reduce(b) + np.uint64(len(s))], np.uint64).tobytes()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text_hash, text): key is the id, or for rows without one text_hash. Rows of one key need not have one text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.select("doc_id", F.coalesce("doc_id", "text_hash").alias("key"), "text_hash", "text")


def shingle_classes(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, text_hash, n_shingles, class) of rows (doc_id, key, text_hash, text); a text without shingles has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.drop_columns(["text"])
            at = 0
            for part, sets in _sets(batch.select(["key", "text"]), width):
                yield pa.RecordBatch.from_arrays(
                    [*ids.slice(at, part.num_rows).columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "key", "text_hash", "n_shingles", "class"]
                )
                at += part.num_rows

    return cut(rows.mapInArrow(tidy(run, forget), "doc_id long, key long, text_hash long, n_shingles long, class binary"), "classes")


_BITS = 48
_KNOWN, _FILLER = 65535, 65534
#: What the exchange carries: a run's ids and what it knows itself (part by name), or its hashes in a range and whose they are.
_NAMES = ["part", "name", "ids", "counts", "gaps", "owners"]
_SENT = "part int, name long, ids binary, counts binary, gaps binary, owners binary"
_FOUND = "name long, ids binary, counts binary, owners binary"


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kind = {"part": pa.int32(), "name": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.get(n, pa.binary())) for k, n in enumerate(names)], names)


def _packed(h: np.ndarray, o: np.ndarray, base: int) -> tuple[bytes, bytes]:
    """Sorted hashes as 32-bit gaps from base and their owners; a gap too wide is bridged by fillers."""
    gaps = np.diff(h, prepend=np.uint64(base))
    wide = gaps >> np.uint64(32)
    if wide.any():
        n = (wide + np.uint64(1)).astype(np.int64)
        at = np.cumsum(n) - 1
        out, own = np.full(at[-1] + 1, 0xFFFFFFFF, np.uint64), np.full(at[-1] + 1, _FILLER, np.uint16)
        out[at], own[at] = gaps - wide * np.uint64(0xFFFFFFFF), o
        # What is left may be just above 32 bits: one more filler would have to take it, so split it evenly.
        over = np.flatnonzero(out > 0xFFFFFFFF)
        for k in over[::-1]:
            rest = int(out[k])
            out[k] = rest - 0xFFFFFFFF
            out, own = np.insert(out, k, 0xFFFFFFFF), np.insert(own, k, _FILLER)
        return out.astype(np.uint32).tobytes(), own.tobytes()
    return gaps.astype(np.uint32).tobytes(), o.tobytes()


def shared_counts(rows: DataFrame, parts: int, width: int = WIDTH) -> DataFrame:
    """(class, shared) of every row (key, text) with shingles: how many of them stand in some other text, or a few more.

    The exchange knows 48 bits of each hash, so that chance can only raise a count. Texts are told apart by their run and
    place; equal texts count as others here, and as one class elsewhere. A row goes out for each run and range of
    hashes, in which a shingle that the run holds twice stands once, so that a frequent one comes once per run.
    """
    from pyspark import TaskContext

    bits = max(0, math.ceil(math.log2(max(1, parts))))
    edges = (np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(_BITS - bits)) if bits else np.array([0, 1 << _BITS], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held) >> np.uint64(64 - _BITS)
            o = np.repeat(np.arange(len(ids)), [len(x) for x in held])
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            alone = first & np.concatenate([first[1:], [True]])
            local = np.bincount(o[~alone], minlength=len(ids))
            keep = np.flatnonzero(first)
            h, o = h[keep], np.where(alone[keep], o[keep], _KNOWN).astype(np.uint16)
            name = (task << 20) + run
            at = np.searchsorted(h, edges)
            rows = [(p, name, None, None, *_packed(h[a:b], o[a:b], int(edges[p]))) for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            for k in range(0, len(rows), 64):
                yield _rows(rows[k : k + 64], _NAMES)
            yield _rows([(name % 2**bits, name, b"".join(ids), local.astype(np.int64).tobytes(), None, None)], _NAMES)

        size = 0
        for batch in batches:
            for _, sets in _sets(batch, width):
                for s in sets:
                    if len(s):
                        held.append(s)
                        ids.append(_name(s))
                        size += len(s)
                        if size > SHINGLES_A_TASK or len(ids) >= 60_000:
                            yield from flush()
                            held, ids, size, run = [], [], 0, run + 1
        if ids:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for b in batches:
            for part, name, ids, counts, gaps, owners in zip(*(b.column(k).to_pylist() for k in range(6))):
                if gaps is None:
                    yield _rows([(name, ids, counts, None)], ["name", "ids", "counts", "owners"])
                    continue
                h = np.cumsum(np.frombuffer(gaps, np.uint32).astype(np.uint64)) + edges[part]
                o = np.frombuffer(owners, np.uint16)
                real = o != _FILLER
                runs.setdefault(part, []).append((h[real], o[real], name))
        for got in runs.values():
            h, o = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            name = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            alone = first & np.concatenate([first[1:], [True]])
            back = order[~alone]
            back = back[o[back] != _KNOWN]
            key, n = np.unique(name[back] << 16 | o[back].astype(np.int64), return_counts=True)
            at = np.searchsorted(key, np.arange(len(got) + 1) << 16)
            out = [(got[k][2], None, n[a:b].astype(np.uint32).tobytes(), (key[a:b] & 0xFFFF).astype(np.uint16).tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            for k in range(0, len(out), 256):
                yield _rows(out[k : k + 256], ["name", "ids", "counts", "owners"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One run after the other: what its own task and every range counted for its texts."""

        def summed(rows: list[tuple]) -> pa.RecordBatch:
            ids = next(np.frombuffer(r[1], "V16") for r in rows if r[1] is not None)
            total = np.zeros(len(ids), np.int64)
            for _, own, counts, owners in rows:
                if own is not None:
                    total += np.frombuffer(counts, np.int64)
                else:
                    total[np.frombuffer(owners, np.uint16)] += np.frombuffer(counts, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(total)], ["class", "shared"])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if rows and row[0] != rows[0][0]:
                    yield summed(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield summed(rows)

    counted = rows.mapInArrow(tidy(send, forget), _SENT).repartitionById(2**bits, "part").mapInArrow(tidy(merge, forget), _FOUND)
    return counted.repartition("name").sortWithinPartitions("name").mapInArrow(tidy(add, forget), "class binary, shared long")


class PrefixTree:
    """Sets of ranks (ascending, commonest first) in a compressed prefix tree. A node's ranks are counted once for all sets below it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.nodes_set: list[int] = []
        start, end, low, high, rest, last, kids, leaf = [], [], [], [], [], [], [], []
        flat, base = [], 0
        seg: list[np.ndarray] = []

        def add(i: int, a: int, b: int) -> int:
            nonlocal base
            seg.append(sets[i][a:b])
            start.append(base)
            base += b - a
            end.append(base)
            low.append(1 << 60)
            high.append(0)
            rest.append(0)
            last.append(int(sets[i][b - 1]) if b else -1)
            kids.append([])
            leaf.append([])
            return len(start) - 1

        root = add(order[0], 0, 0)
        # The rightmost way: nodes with the depth they reach.
        way = [(root, 0)]
        before = None
        for i in order:
            s = sets[i]
            common = 0
            if before is not None:
                p = sets[before]
                m = min(len(p), len(s))
                differs = np.flatnonzero(p[:m] != s[:m])
                common = int(differs[0]) if len(differs) else m
            cut_off = None
            while way[-1][1] > common:
                cut_off = way.pop()
            if way[-1][1] < common:
                # A node ends inside the way: its upper part becomes a node of its own.
                parent, depth = way[-1]
                lower = cut_off[0]
                upper = add(before, depth, common)
                kids[parent][kids[parent].index(lower)] = upper
                kids[upper].append(lower)
                k = common - depth
                seg[lower] = seg[lower][k:]
                way.append((upper, common))
            if len(s) > way[-1][1]:
                node = add(i, way[-1][1], len(s))
                kids[way[-1][0]].append(node)
                way.append((node, len(s)))
            leaf[way[-1][0]].append(i)
            before = i
        # Parts were split: lay the segments out again, and sum up from the leaves.
        n = len(start)
        size = np.array([len(x) for x in seg])
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.flat = np.concatenate(seg) if seg else np.zeros(0, np.int64)
        stack, post = [root], []
        while stack:
            x = stack.pop()
            post.append(x)
            stack += kids[x]
        for x in reversed(post):
            lengths = [int(sizes[i]) for i in leaf[x]]
            low[x] = min([*lengths, *(low[k] for k in kids[x])])
            high[x] = max([*lengths, *(high[k] for k in kids[x])])
            rest[x] = max([0, *(rest[k] + int(size[k]) for k in kids[x])])
        self.low, self.high, self.rest, self.last = np.array(low), np.array(high), np.array(rest), np.array(last)
        self.kid_start = np.concatenate([[0], np.cumsum([len(k) for k in kids])])
        self.kids = np.array([k for x in kids for k in x], np.int64)
        self.leaf_start = np.concatenate([[0], np.cumsum([len(x) for x in leaf])])
        self.leaves = np.array([i for x in leaf for i in x], np.int64)
        self.sizes, self.root = sizes, root

    def linked(self, ranks: np.ndarray, size: int, inside: np.ndarray, percent: int) -> np.ndarray:
        """Sets whose similarity to the given one (its ranks, ascending) is percent / 100 or more. inside: of each rank, whether the set has it."""
        nodes, overlap = np.array([self.root]), np.array([0])
        out = []
        while len(nodes):
            own = _ragged(self.leaf_start[nodes], self.leaf_start[nodes + 1])
            if len(own):
                found = self.leaves[own]
                o = np.repeat(overlap, self.leaf_start[nodes + 1] - self.leaf_start[nodes])
                ok = 100 * o >= percent * (size + self.sizes[found] - o)
                if ok.any():
                    out.append(found[ok])
            n = self.kid_start[nodes + 1] - self.kid_start[nodes]
            kids = self.kids[_ragged(self.kid_start[nodes], self.kid_start[nodes + 1])]
            if not len(kids):
                break
            so_far = np.repeat(overlap, n)
            # Lengths alone, before anything is counted: the sizes below, and what both sides have left.
            small = np.maximum(self.low[kids], -(-percent * size // 100))
            need = -(-percent * (size + small) // (100 + percent))
            fits = (percent * size <= 100 * self.high[kids]) & (percent * self.low[kids] <= 100 * size) & (so_far + self.end[kids] - self.start[kids] + self.rest[kids] >= need)
            kids, so_far, need = kids[fits], so_far[fits], need[fits]
            where = _ragged(self.start[kids], self.end[kids])
            length = self.end[kids] - self.start[kids]
            counts = np.concatenate([[0], np.cumsum(inside[self.flat[where]])])
            stops = np.cumsum(length)
            so_far = so_far + counts[stops] - counts[stops - length]
            left = np.minimum(len(ranks) - np.searchsorted(ranks, self.last[kids], "right"), self.rest[kids])
            stays = so_far + left >= need
            nodes, overlap = kids[stays], so_far[stays]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _ragged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, end), one after the other."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.int64)
    stops = np.cumsum(n)
    return np.repeat(starts - (stops - n), n) + np.arange(stops[-1])


def block_links(every: list[tuple[bytes, int, np.ndarray]], probes: list[int] | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Links (a, b) that join all linked sets of a block: a forest, not all pairs. every: name, group and set; sets of one group need no link.
    probes: the places of the sets that walk the tree of all sets (by default, all)."""
    tokens = np.concatenate([s for _, _, s in every])
    seen, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((seen, -count))
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    ranks = rank[inverse]
    used = int((count > 1).sum())  # shingles of one set overlap with none; they come last
    bounds = np.concatenate([[0], np.cumsum([len(s) for _, _, s in every])])
    sets = [np.sort(r[r < used]) for r in (ranks[a:b] for a, b in zip(bounds[:-1], bounds[1:]))]
    sizes = np.diff(bounds)
    tree = PrefixTree(sets, sizes)
    label, out = np.array([g for _, g, _ in every]), []
    inside = np.zeros(used + 1, np.int64)
    for i in range(len(every)) if probes is None else probes:
        inside[sets[i]] = 1
        found = tree.linked(sets[i], int(sizes[i]), inside, percent)
        inside[sets[i]] = 0
        labels, at = np.unique(label[found], return_index=True)
        new = labels != label[i]
        if new.any():
            out += [(every[i][0], every[j][0]) for j in found[at[new]].tolist()]
            label[np.isin(label, labels)] = label[i]
    return out


def stars(links: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The links of a block as (name, smallest name that it reaches): what joins no other block's links needs no further step."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _candidates(rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(class, tokens): sets of the classes that have enough shingles in common with others."""
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHINGLES_A_TASK))
    counts = shared_counts(rows.select("key", "text"), parts, width).groupBy("class").agg(F.max("shared").alias("shared"))
    known = classes.filter("class IS NOT NULL").groupBy("class").agg(F.min("n_shingles").alias("least"), F.min("key").alias("key"))
    kept = cut(counts.join(known, "class").filter(100 * F.col("shared") >= percent * F.col("least")).select("class", "key"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, width):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "tokens"])

    # One text of each class is read; a key that repeats may bring texts of other classes, which the second join drops.
    many = hot_keys(classes.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    texts = join_hot(rows.select("key", "text"), kept.select("key").distinct(), ["key"], many, ["text"], "left_semi")
    sets = texts.select("key", "text").mapInArrow(tidy(run, forget), "class binary, tokens array<long>").dropDuplicates(["class"])
    return cut(sets.join(kept.select("class").hint("merge"), "class", "left_semi"), "sets")


def _clusters(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(class, cluster) of sets that share a shingle of their prefixes with another one, rarest first; and (class, token, left), those shingles, with how many of the set's come from there on."""
    long = sets.select("class", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    # What one set alone has comes first in its order: it is counted, not sorted.
    df = cut(long.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "frequencies")
    whole = Window.partitionBy("class", "size")
    counted = join_hot(long, df, ["token"], hot_keys(df, ["token"]), ["class"])
    left = F.count("*").over(whole) - F.row_number().over(whole.orderBy("n", "token")) + 1
    heads = cut(counted.withColumn("left", left).filter(F.col("left") >= F.ceil(F.col("size") * percent / 100)).select("class", "token", "left"), "heads")
    least = cut(heads.groupBy("token").agg(F.min("class").alias("least"), F.count("*").alias("n")).filter("n > 1"), "least")
    edges = join_hot(heads, least.select("token", "least"), ["token"], hot_keys(least, ["token"]), ["class"]).filter("class <> least")
    found = connected_components(edges.select(F.col("class").alias("a"), F.col("least").alias("b")))
    return found.select(F.col("node").alias("class"), F.col("component").alias("cluster")), heads


def _linked(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links of blocks of sets, rows (cluster, block, probe, class, group, tokens): a set walks its block's tree if probe is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(rows: list[tuple]) -> pa.RecordBatch:
            groups: dict = {}
            every = [(name, groups.setdefault(group if group is not None else name, len(groups)), tokens) for _, name, group, tokens in rows]
            links = stars(block_links(every, [k for k, r in enumerate(rows) if r[0]], percent))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

        now, rows = None, []
        for batch in batches:
            lists = batch.column(5)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (cluster, block, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (cluster, block) != now:
                    if len(rows) > 1:
                        yield joined(rows)
                    now, rows = (cluster, block), []
                rows.append((*row, np.array(values[offsets[k] : offsets[k + 1]]).view(np.uint64)))
        if len(rows) > 1:
            yield joined(rows)

    order = ["cluster", "block", "class"]
    return blocks.select("cluster", "block", "probe", "class", "group", "tokens").repartition("cluster", "block").sortWithinPartitions(*order).mapInArrow(tidy(run, forget), "a binary, b binary")


def _pieces(member: DataFrame, shingles_a_piece: int) -> DataFrame:
    """member (cluster, class, ...) with size, pieces and block: a cluster of more shingles than a piece holds is dealt by hashes of its classes."""
    sizes = cut(member.groupBy("cluster").agg(F.sum("size").alias("n"), F.count("*").alias("rows")), "sizes")
    pieces = sizes.select("cluster", F.ceil(F.col("n") / shingles_a_piece).cast("int").alias("pieces"))
    dealt = join_hot(member, pieces, ["cluster"], hot_keys(sizes, ["cluster"], "rows"), ["class"])
    return dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int"))


def _links(sets: DataFrame, clusters: DataFrame, heads: DataFrame, percent: int, shingles_a_piece: int) -> DataFrame:
    """(a, b): links that join all linked sets. heads: the shingles of each set's prefix that others have in theirs."""
    nobody = F.lit(None).cast("binary").alias("group")
    own = cut(_pieces(sets.withColumn("size", F.size("tokens")).join(clusters.hint("merge"), "class"), shingles_a_piece), "pieces")
    blocks, large = own.select("*", F.lit(True).alias("probe"), nobody), own.filter("pieces > 1")
    many = bool(large.head(1))
    if many:
        # The first piece stands in every other one too: whatever links with one of its sets is of one group with them.
        blocks = blocks.unionByName(large.filter("block = 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("pieces") - 1))).select("*", F.lit(False).alias("probe"), nobody))
    first = cut(_linked(blocks, percent), "links")
    if not many:
        return first
    # Clusters of several pieces: one set of each group that a piece has linked meets the others.
    grouped = cut(_grouped(large, first), "groups")
    leaders = grouped.filter("class = group").drop("pieces", "block", "group")
    second = cut(_linked(_pieces(leaders, shingles_a_piece).select("*", F.lit(True).alias("probe"), nobody), percent), "links")
    # Sets outside their cluster's largest group meet the pieces that hold one of their prefix shingles; inside it, no link is missing.
    grouped = cut(_grouped(large, first.union(second)), "groups")
    largest = grouped.groupBy("cluster", "group").agg(F.count("*").alias("_n")).groupBy("cluster").agg(F.max(F.struct("_n", "group")).alias("_top")).select("cluster", F.col("_top.group").alias("_largest"))
    counts = own.groupBy("cluster").agg(F.count("*").alias("n"))
    told = cut(join_hot(grouped, largest, ["cluster"], hot_keys(counts, ["cluster"]), ["class"]).withColumn("_rest", F.col("group") != F.col("_largest")), "told")
    if not told.filter("_rest").head(1):
        return cut(first.union(second), "links")
    guests = _guests(told, heads, percent)
    third = _linked(told.select("cluster", "block", F.lit(False).alias("probe"), "class", "group", "tokens").union(guests.select("cluster", "block", F.lit(True), "class", "group", "tokens")), percent)
    return cut(first.union(second).union(third), "links")


def _guests(told: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(cluster, block, class, group, tokens): the sets of told (cluster, block, class, group, size, tokens, _rest) that are _rest, once for each other piece that may hold a set linked with them.

    The first piece has met all others. Two linked sets share a shingle of their prefixes, and from the first such shingle on both have as many as a link needs of
    sets of their sizes. So a set goes to a piece only if that piece holds, among its sets of a fitting length, one of its prefix shingles (heads: class, token, left) with
    enough left on both sides, and neither all sets nor all pieces of a cluster meet. Lengths are compared by bands that are wider than two linked sets may differ, so that links reach
    over one band at most.
    """
    band = F.floor(F.log("size") / math.log(max(1.5, 110 / percent))).cast("int")
    placed = told.filter("block > 0").select("cluster", "block", "class", "size", "_rest", band.alias("band"))
    tokens = cut(heads.join(placed.hint("merge"), "class"), "tokens")
    # A shingle of very many sets stands once for each piece and band, and a guest asks for each of its own once.
    held = tokens.groupBy("cluster", "token", "band", "block").agg(F.min("size").alias("_least"), F.max("left").alias("_most"))
    asked = tokens.filter("_rest").select("cluster", "token", "class", "size", "left", F.col("block").alias("_home"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    enough = (100 + percent) * F.least("left", "_most") >= percent * (F.col("size") + F.col("_least"))
    to = asked.join(held.hint("merge"), ["cluster", "token", "band"]).filter((F.col("block") != F.col("_home")) & enough).select("cluster", "class", "block").distinct()
    return told.filter("_rest").drop("block").join(to.hint("merge"), ["cluster", "class"])


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (class, ...) with group: the smallest class that links reach."""
    found = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("group"))
    return rows.join(found.hint("merge"), "class", "left").withColumn("group", F.coalesce("group", "class"))


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", shingles_a_piece: int = SHINGLES_A_PIECE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A-Z are lower-cased; words are [^\x20\x09-\x0D]+; a set has the text's distinct runs of `width` words, or all its words if they are fewer. Two
    texts link when 100 * |intersection| >= percent * |union| (percent from 1 to 100). component_id: the smallest id reachable by links. A
    null text, or one without words, has no shingles, links with nothing and is its own component; equal texts link. Rows
    that repeat an id are told apart by their texts. A row without an id links like any other, and gets the smallest id of
    its component, or null if none of it has one. Other columns are ignored; an empty table gives an empty result. Shingles are
    compared by 64-bit hashes, sets by 128 bits.
    """
    return ngram_classes(docs, width, percent, id_col, text_col, shingles_a_piece).select("doc_id", "n_shingles", "component_id")


def ngram_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", shingles_a_piece: int = SHINGLES_A_PIECE) -> DataFrame:
    """The columns of ngram_join, and key, text_hash and component: what component a row is of, also where it has no id; null without shingles."""
    rows = _keyed(docs, id_col, text_col)
    marked = shingle_classes(rows, width)
    sets = _candidates(rows, marked, width, percent)
    links = _links(sets, *_clusters(sets, percent), percent, shingles_a_piece)
    found = connected_components(links).select(F.col("node").alias("class"), "component")
    classes = marked.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = cut(classes.join(found.hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class")), "named")
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    of_class = join_hot(named.select("class", "component"), ids.drop("n"), ["component"], hot_keys(ids, ["component"]), ["class"])
    with_words = join_hot(marked.filter("class IS NOT NULL"), of_class, ["class"], hot_keys(named, ["class"]), ["doc_id"])
    without = marked.filter("class IS NULL").select("doc_id", "key", "text_hash", "n_shingles", "class", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"))
    return with_words.select("doc_id", "key", "text_hash", "n_shingles", "class", "component", "component_id").union(without)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = w.doc_id
"""
