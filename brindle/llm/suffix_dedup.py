"""Suffix-array dedup: removes every byte that a string of `length` bytes, found anywhere else too, covers.

A full suffix array would hold each byte of the corpus as a suffix; here only some suffixes are sorted, chosen by content so
that equal strings choose alike: each window of `length` bytes is stood for by the smallest hash among its strings of
GRAM bytes, its anchor. An anchor has a context: the bytes of all windows it stands for.

1. Sorted, packed runs of (anchor hash, context hash) are exchanged by ranges of the hash. An anchor found once can't be
   in a repeated window; all others are candidates. Hashes decide nothing else.
2. The suffixes that begin at candidates are sorted by a distributed merge sort: every task makes sorted runs,
   front-coded (the prefix shared with the suffix before, and the rest), in which equal contexts stand once, with a mark.
   They are exchanged; a loser tree merges the runs of a range and never looks at a prefix that is known to be
   shared, and its output says how long each suffix agrees with the one before. A window that begins d bytes before its
   anchor is found twice if, within a stretch that agrees on length - d bytes, the d bytes before the anchor agree too.
   Windows that begin near before the anchor and far before it are sorted apart: the near ones share what follows
   the anchor, the far ones what stands before it, and suffixes are dealt by what they must share. So a gram that
   stands in very many contexts is spread over the ranges.
3. The repeated windows of a text are put together to spans.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hashing import BASES, mix, prefix_hash, span_hash
from brindle.session import cut

LENGTH = 200
GRAM = 64
#: Bytes of text hashed at once, and anchors a run and a range of the exchange hold about.
_CHUNK = 1 << 20
ANCHORS_A_RUN = 400_000
ANCHORS_A_RANGE = 400_000
#: Different suffixes that a run of the merge sort holds about.
SUFFIXES_A_RUN = 60_000


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: text, place in it, least and largest distance of the windows' starts before it, hash of its gram, hash of its context."""
    n = sum(map(len, texts))
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    grams = prefix_hash(data, BASES[0])
    at = np.arange(n - gram + 1)
    hashes = span_hash(grams, at, at + gram, BASES[0])
    # Smallest (hash, place) in each window: minima over 2, 4, 8 ... places, and two of them that overlap.
    bits = np.uint64(int(n).bit_length())
    low = (hashes >> bits << bits) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: n - length + 1]
    start = np.arange(n - length + 1)
    whole = np.flatnonzero(ends[text] - start >= length)
    if not len(whole):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor, text = anchor[whole], text[whole]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    x, t, from_, to = anchor[first], text[first], whole[first], whole[last]
    near, far = x - to, x - from_
    context = mix(span_hash(prefix_hash(data, BASES[1]), from_, to + length, BASES[1]) + (near * 1000 + far).astype(np.uint64))
    # Anchors are the smallest hashes around, so their hashes crowd at the low end; mixed again, they spread over all ranges.
    return t, x - (ends[t] - sizes[t]), near, far, mix(hashes[x]), context


def _code(x, near, far):
    return (x << 16) | (near << 8) | far


def _uncode(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    return codes >> 16, (codes >> 8) & 255, codes & 255


_LISTS = pa.list_(pa.int64())
#: What the exchanges carry: a run's keys and what it knows itself (part by name), or its entries in a range.
_NAMES = ["part", "name", "keys", "owners", "codes", "blob"]
_SENT = "part int, name long, keys binary, owners binary, codes binary, blob binary"
_FOUND = "name long, keys binary, owners binary, codes binary"


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kind = {"part": pa.int32(), "name": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.get(n, pa.binary())) for k, n in enumerate(names)], names)


def _own(name: int, parts: int, keys: list[tuple[int, int]], owners: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """The row of a run that stays with its name."""
    return _rows([(name % parts, name, np.array(keys, np.int64).tobytes(), owners.astype(np.int32).tobytes(), codes.astype(np.int64).tobytes(), None)], _NAMES)


def _passed_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of runs that stay with their names."""
    own = batch.filter(pa.compute.is_null(batch.column(5)))
    if own.num_rows:
        yield pa.RecordBatch.from_arrays([own.column(k) for k in range(1, 5)], _NAMES[1:5])


def _sent_back(names: list[int], run: np.ndarray, owners: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each run: its owners and their codes."""
    order = np.argsort(run, kind="stable")
    at = np.searchsorted(run[order], np.arange(len(names) + 1))
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            mine = order[a:b]
            yield _rows([(names[k], None, owners[mine].astype(np.int32).tobytes(), codes[mine].astype(np.int64).tobytes())], _NAMES[1:5])


def _own_codes(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and codes of a run, from what it knows itself and what the ranges found."""
    return np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64), np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])


def _placed(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Owners and stretches of windows (first start << 24 | more starts) of a run: what the ranges found of its suffixes, at each place of each.

    The run's own row has (suffix, place of the anchor) and owner of every place, in order of suffixes."""
    own = next(r for r in rows if r[1] is not None)
    owner, of = np.frombuffer(own[2], np.int32).astype(np.int64), np.frombuffer(own[3], np.int64)
    suffix, x = of >> 32, of & 0xFFFFFFFF
    item = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[2], np.int32).astype(np.int64) for r in rows if r is not own)])
    code = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[3], np.int64) for r in rows if r is not own)])
    a, b = np.searchsorted(suffix, item), np.searchsorted(suffix, item, "right")
    n = b - a
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    far, more = np.repeat(code >> 24, n), np.repeat(code & 0xFFFFFF, n)
    return owner[at], (x[at] - far) << 24 | more


def _by_text(found: DataFrame, read: Callable[[list[tuple]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(k1, k2, codes) of the texts that have codes: what `read` makes of each run's rows, one run after the other."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            keys = next(np.frombuffer(r[1], np.int64).reshape(-1, 2) for r in rows if r[1] is not None)
            lists = list(_lists_by(*read(rows)))
            for k in range(0, len(lists), 2000):
                piece = lists[k : k + 2000]
                of = keys[[o for o, _ in piece]]
                yield pa.RecordBatch.from_arrays([pa.array(of[:, 0]), pa.array(of[:, 1]), pa.array([c for _, c in piece], _LISTS)], ["k1", "k2", "codes"])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if rows and row[0] != rows[0][0]:
                    yield from told(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from told(rows)

    texts = found.repartition("name").sortWithinPartitions("name").mapInArrow(gather, "k1 long, k2 long, codes array<long>")
    # Rows equal in id and text are one key; their codes are the same.
    return texts.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))


def _lists_by(owner: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(owner, its codes) for each owner."""
    order = np.argsort(owner, kind="stable")
    owner, codes = owner[order], codes[order]
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(owner[a]), codes[a:b].tolist()


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


_RUN = np.dtype([("g", "<u8"), ("c", "<u8"), ("code", "<i8"), ("owner", "<u2"), ("many", "u1")])


def _states(rows: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(k1, k2, codes): the anchors of each text whose gram is found elsewhere too."""
    from pyspark import TaskContext

    bits = max(0, math.ceil(math.log2(max(1, parts))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        keys: list[tuple[int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a = np.concatenate(held)
            a = a[np.lexsort((a["c"], a["g"]))]
            name = (task << 20) + run
            first = np.concatenate([[True], (a["g"][1:] != a["g"][:-1]) | (a["c"][1:] != a["c"][:-1])])
            alone = first & np.concatenate([first[1:], [True]])
            # Contexts that the run holds twice are candidates; one of each is sent, for others to be found by.
            owners, codes = a["owner"][~alone].astype(np.int64), a["code"][~alone]
            a["many"] = ~alone
            a = a[first]
            at = np.searchsorted(a["g"] >> np.uint64(64 - bits) if bits else np.zeros(len(a), np.uint64), np.arange(2**bits + 1, dtype=np.uint64))
            sent = [(p, name, None, None, None, a[i:j].tobytes()) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
            for k in range(0, len(sent), 64):
                yield _rows(sent[k : k + 64], _NAMES)
            yield _own(name, 2**bits, keys, owners, codes)

        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts = _bytes(batch.column(2))
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= _CHUNK):
                    n += len(texts[j])
                    j += 1
                if len(keys) + (j - i) > 60_000 or size > ANCHORS_A_RUN:
                    yield from flush()
                    held, keys, size, run = [], [], 0, run + 1
                t, x, near, far, g, c = anchors(texts[i:j], length, gram)
                a = np.zeros(len(t), _RUN)
                a["g"], a["c"], a["code"], a["owner"] = g, c, _code(x, near, far), t + len(keys)
                held.append(a)
                keys += zip(k1[i:j], k2[i:j])
                size += len(a)
                i = j
        if keys:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            yield from _passed_on(b)
            runs = b.filter(pa.compute.is_valid(b.column(5)))
            for part, name, raw in zip(*(runs.column(k).to_pylist() for k in (0, 1, 5))):
                ranges.setdefault(part, []).append((name, np.frombuffer(raw, _RUN)))
        for part in sorted(ranges):
            got = ranges.pop(part)
            a = np.concatenate([r for _, r in got])
            run = np.repeat(np.arange(len(got)), [len(r) for _, r in got])
            order = np.argsort(a["g"], kind="stable")
            a, run = a[order], run[order]
            new_gram = np.concatenate([[True], a["g"][1:] != a["g"][:-1]])
            of_gram = np.cumsum(new_gram) - 1
            told = (np.bincount(of_gram, 1 + a["many"]) >= 2)[of_gram] & (a["many"] == 0)
            yield from _sent_back([n for n, _ in got], run[told], a["owner"][told], a["code"][told])

    return _by_text(rows.mapInArrow(send, _SENT).repartitionById(2**bits, "part").mapInArrow(merge, _FOUND), _own_codes)


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted suffixes as lengths, lengths of the prefix shared with the one before, and the rest of each."""
    shared = [0]
    for a, b in zip(suffixes, suffixes[1:]):
        shared.append(common_prefix(a, b, 0))
    lengths = bytes(len(s) for s in suffixes)
    return lengths, bytes(shared), b"".join(s[k:] for s, k in zip(suffixes, shared))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the shared prefix, of which `known` bytes are known to be shared."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


class Run:
    """A front-coded run, read from the front: its present suffix, and how much of it the one before had."""

    def __init__(self, lengths: bytes, shared: bytes, rest: bytes):
        self.lengths, self.lcps, self.rest = lengths, shared, rest
        self.at, self.place, self.suffix = -1, 0, b""

    def step(self) -> int:
        """To the next suffix; the prefix it shares with the last, or -1 at the end."""
        self.at += 1
        if self.at == len(self.lengths):
            return -1
        shared = self.lcps[self.at]
        n = self.lengths[self.at] - shared
        self.suffix = self.suffix[:shared] + self.rest[self.place : self.place + n]
        self.place += n
        return shared


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the suffix before) in the order of all suffixes.

    A loser tree: at every inner node waits the suffix that lost there, with the prefix it shares with the last winner. Of
    two suffixes the one that shares more with the last winner is smaller; only if they share the same are bytes
    compared, from there on. A run at its end shares -1.
    """
    n = 1
    while n < len(runs):
        n *= 2
    share = [-1] * n
    for k, r in enumerate(runs):
        if r.step() >= 0:
            share[k] = 0
    loser = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's share is set."""
        x, y = share[a], share[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = runs[a].suffix, runs[b].suffix
        k = common_prefix(s, t, x)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            share[b] = k
            return a, b
        share[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return winner

    winner = build(1) if n > 1 else 0
    while share[winner] >= 0:
        yield winner, runs[winner].at, share[winner]
        share[winner] = runs[winner].step()
        node = (winner + n) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def repeated_starts(lcp: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order and each distance d before an anchor, whether the window from there is found twice.

    left[i, d - 1]: the byte d before anchor i. many: whether suffix i stands for several places. The answer is [i, d] for near[i] <= d <= far[i].
    """
    n, top = len(lcp), int(far.max()) + 1
    out = np.zeros((n, top), bool)
    hashes = np.zeros(n, np.uint64)
    for d in range(top):
        if d:
            hashes = mix(hashes + left[:, d - 1].astype(np.uint64) + np.uint64(d << 9))
        has = np.flatnonzero((near <= d) & (d <= far))
        if len(has) > 1:
            stretch = np.cumsum(lcp < length - d)
            key = mix(hashes[has] + mix(stretch[has].astype(np.uint64)))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            out[has, d] = count[inverse] > 1
    has = np.arange(top)
    out |= many[:, None] & (near[:, None] <= has) & (has <= far[:, None])
    return out


def _sorted_spans(rows: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(k1, k2, codes): for texts (k1, k2, text, codes), windows found by the merge sort, first start and number of further ones packed as first << 24 | further."""
    from pyspark import TaskContext

    head = np.dtype([("item", "<i4"), ("near", "u1"), ("far", "u1"), ("many", "u1")])
    middle = (length - gram) // 2
    classes = ((0, middle), (middle + 1, length - gram))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run, keys, size = TaskContext.get().partitionId(), 0, [], 0
        # (suffix, bytes before it, class): its places, as owner and place of the anchor.
        held: dict[tuple[bytes, bytes, int], list[tuple[int, int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            name = (task << 20) + run
            ranges: dict[int, list[tuple]] = {}
            owners, of = [], []
            for item, ((suffix, left, c), places) in enumerate(held.items()):
                # What all windows of the class have: enough of the bytes before the anchor, and of those after it.
                low, high = classes[c]
                word = hashlib.blake2b(left[len(left) - low :] + b"|" + suffix[: length - high], digest_size=6, salt=bytes([c])).digest()
                ranges.setdefault(int.from_bytes(word, "little") % parts, []).append((suffix, left, (item, length - len(suffix), len(left), len(places) > 1)))
                owners += [o for o, _ in places]
                of += [item << 32 | x for _, x in places]
            for part, items in sorted(ranges.items()):
                items.sort(key=lambda i: i[0])
                info = np.array([i[2] for i in items], head)
                pieces = [*front_coded([i[0] for i in items]), b"".join(i[1].rjust(length, b"\0") for i in items), info.tobytes()]
                lengths = np.array([len(p) for p in pieces], "<i4").tobytes()
                yield _rows([(part, name, None, None, None, lengths + b"".join(pieces))], _NAMES)
            yield _own(name, parts, keys, np.array(owners, np.int64), np.array(of, np.int64))

        for batch in batches:
            texts = _bytes(batch.column(2))
            for k1, k2, text, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                owner = len(keys)
                keys.append((k1, k2))
                for a, near, far in zip(*(v.tolist() for v in _uncode(np.array(codes, np.int64)))):
                    for c, (low, high) in enumerate(classes):
                        d, e = max(near, low), min(far, high)
                        if d <= e:
                            held.setdefault((text[a : a + length - d], text[a - e : a], c), []).append((owner, a))
                    if len(held) > SUFFIXES_A_RUN or (size := size + 1) > 10 * SUFFIXES_A_RUN:
                        yield from flush()
                        run, keys, held, size, owner = run + 1, [(k1, k2)], {}, 0, 0
        if keys:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            yield from _passed_on(b)
            runs = b.filter(pa.compute.is_valid(b.column(5)))
            for part, name, raw in zip(*(runs.column(k).to_pylist() for k in (0, 1, 5))):
                ranges.setdefault(part, []).append((name, raw))
        for part in sorted(ranges):
            runs, lefts, infos, names = [], [], [], []
            for name, raw in ranges.pop(part):
                sizes = np.frombuffer(raw[:20], "<i4")
                cuts = np.concatenate([[20], 20 + np.cumsum(sizes)]).tolist()
                lengths, shared, rest, left, info = (raw[a:b] for a, b in zip(cuts, cuts[1:]))
                runs.append(Run(lengths, shared, rest))
                lefts.append(np.frombuffer(left, np.uint8).reshape(-1, length)[:, ::-1])
                infos.append(np.frombuffer(info, head))
                names.append(name)
            order = np.array(list(merged(runs)), np.int64).reshape(-1, 3)
            base = np.cumsum([0, *map(len, infos)])
            at = base[order[:, 0]] + order[:, 1]
            info, left = np.concatenate(infos)[at], np.concatenate(lefts)[at]
            twice = repeated_starts(order[:, 2], left, info["near"].astype(int), info["far"].astype(int), info["many"] > 0, length)
            edge = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, first = np.nonzero(edge == 1)
            _, after = np.nonzero(edge == -1)
            # From the farthest start before the anchor, and how many more follow.
            codes = (after - 1).astype(np.int64) << 24 | (after - first - 1)
            yield from _sent_back(names, order[i, 0], info["item"][i], codes)

    return _by_text(rows.mapInArrow(send, _SENT).repartitionById(parts, "part").mapInArrow(merge, _FOUND), _placed)


def spans_of(starts: Iterable[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes [from, to) covered by windows that start at first ... last."""
    out: list[list[int]] = []
    for first, last in sorted(starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans (array of from, to: bytes that are repeated, in order) for every row of docs.

    A text is its UTF-8 bytes; null is empty. A byte is repeated if a string of `length` bytes that covers it starts also at
    another place of the same or another row; strings do not cross rows, and overlapping strings count. Rows that are
    copies of each other, with one id or two, repeat each other. Texts shorter than `length` bytes have no spans; other columns
    are ignored; an empty table gives an empty result. length: 2 * gram up to 255.
    """
    rows = _keyed(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 60 / ANCHORS_A_RANGE))
    keys = ["k1", "k2"]
    candidates = cut(_states(rows.select("k1", "k2", "text"), parts, length, gram), "candidates")
    # Texts and their anchors both grow with the input: merge joins at every size; both joins read one exchange of the texts.
    opened = rows.join(candidates.hint("merge"), keys).select("k1", "k2", "text", "codes")
    found = cut(_sorted_spans(opened, parts, length, gram), "spans").withColumnRenamed("codes", "found")
    joined = rows.join(found.hint("merge"), keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for b in batches:
            spans = []
            for found in b.column(2).to_pylist():
                starts = [(c >> 24, (c >> 24) + (c & 0xFFFFFF)) for c in found or []]
                spans.append([{"from": a, "to": e} for a, e in spans_of(starts, length)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return joined.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, text string, spans array<struct<from: int, to: int>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the rows of repeated_spans."""
    # Bytes, not characters, are kept: substring works on the text as binary.
    raw = F.col("text").cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["to"]))
    ends = F.concat(F.transform("spans", lambda s: s["from"]), F.array(F.octet_length("text")))
    pieces = F.zip_with(starts, ends, lambda a, e: F.hex(F.substring(raw, a + 1, e - a)))
    return found.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(F.size("spans") == 0, F.sha2(raw, 256)).otherwise(F.sha2(F.unhex(F.array_join(pieces, "")), 256)).alias("kept_sha256"),
    )
