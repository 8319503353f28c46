"""BPE encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.memory import tidy

VOCABULARY = "word_bpe_49k.json"
#: White space as the tokenizer's own patterns see it.
_SPACE = r"[\t-\r \x85\xa0  -     　]"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|(?:(?!{_SPACE})[^\p{{L}}\p{{N}}])+")
_CHUNK = regex.compile(rf"(?:(?!{_SPACE}).)+", regex.DOTALL)
#: str.split() also splits at these four, which the tokenizer takes for symbols.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_NO_RANK = 1 << 30
#: Bytes of chunks, and of words, that a worker remembers with their ids, and pairs of tokens; beyond them the memory starts anew. They bound memory, not results.
CHUNK_BYTES, WORD_BYTES = 16 << 20, 64 << 20
REMEMBERED_PAIRS = 200_000
#: What an entry takes besides its characters and ids, about; and the length from which a piece of text is not remembered.
_ENTRY_BYTES, _LONG = 160, 64


class Memory(dict):
    """Ids by piece of text, as bytes. Long pieces are not kept; all are forgotten where they would take more than `limit` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) < _LONG:
            self.held += _ENTRY_BYTES + 4 * len(piece) + len(ids)
            if self.held > self.limit:
                self.clear()
                self.held = _ENTRY_BYTES + 4 * len(piece) + len(ids)
            self[piece] = ids


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary with an end-of-word suffix.

    A word is a string of symbols: chr(byte), and chr(256 + byte) for its last byte. Every merge makes one token, so a
    token has one pair it comes from. Two tokens may stand side by side exactly if no merge across their border would
    have come first (compatible); the encoder takes the longest token at each place, falls back to shorter ones, and
    steps back where none is compatible. One pass of an automaton of the reversed tokens over the reversed word finds the
    longest token of every place, and a place from which no way leads on is not tried twice: the time is linear in the
    word's length.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab: dict[str, int] = model["vocab"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            chars = [chr(byte_of[c]) for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                chars[-1] = chr(ord(chars[-1]) + 256)
            return "".join(chars)

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            token = vocab[a + b]
            self.rank[pair] = r
            if token not in self.parts:
                self.parts[token], self.made_at[token] = pair, r
        self.text = {i: symbols(t) for t, i in vocab.items()}
        self.size = {i: len(s) for i, s in self.text.items()}
        self.symbol = {s: i for i, s in self.text.items() if len(s) == 1}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._compatible: dict[int, bool] = {}
        #: Tokens that merging their own symbols gives, by their symbols; the others never come out of a merge.
        table = {s: i for i, s in self.text.items() if i not in self.parts or self._reachable(i)}
        self.tokens = ahocorasick.Automaton()
        for s, i in table.items():
            self.tokens.add_word(s[::-1], i)
        self.tokens.make_automaton()
        #: The next shorter token that starts a token.
        self.shorter: dict[int, int | None] = {i: next((table[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in table), None) for s, i in table.items()}
        specials = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        #: The first id above the vocabulary.
        self.top = top = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * top
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t.encode()
        self.names = offset_table(names)
        self.decimals = offset_table([str(i).encode() for i in range(top)])
        self.chunks, self.words = Memory(CHUNK_BYTES), Memory(WORD_BYTES)

    def _reachable(self, token: int) -> bool:
        """Whether merging a token's own symbols gives the token: its two parts can be reached and stand side by side until they merge."""
        a, b = self.parts[token]
        return self.merged([self.symbol[c] for c in self.text[token]]) == [token] if len(self.text[token]) > 2 else (a, b) in self.rank

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, lowest rank first and leftmost first; the rule that the encoder has to agree with."""
        ids = list(ids)
        while len(ids) > 1:
            best, at = min((self.rank.get((ids[k], ids[k + 1]), _NO_RANK), k) for k in range(len(ids) - 1))
            if best == _NO_RANK:
                break
            ids[at : at + 2] = [self._by_rank(ids[at], ids[at + 1])]
        return ids

    def _by_rank(self, a: int, b: int) -> int:
        if not hasattr(self, "_made"):
            self._made = {pair: token for token, pair in self.parts.items()}
        return self._made[(a, b)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their symbols are merged as one text."""
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= REMEMBERED_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        # At any time the border lies between a piece at a's right edge and one at b's left edge; each piece lives until
        # the merge that makes its parent. Rank ties: the leftmost pair merges first, so one in a comes before one across.
        rank, parts, made_at = self.rank, self.parts, self.made_at
        left, left_end = a, _NO_RANK
        right, right_end = b, _NO_RANK
        while True:
            across = rank.get((left, right), _NO_RANK)
            if across < left_end and across <= right_end and across != _NO_RANK:
                return False
            left_at, right_at = made_at.get(left, -1), made_at.get(right, -1)
            if left_at < 0 and right_at < 0:
                return True
            # Undo the later of the two merges.
            if left_at >= right_at:
                left_end, left = left_at, parts[left][1]
            else:
                right_end, right = right_at, parts[right][0]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word (its UTF-8 bytes, at least one)."""
        s = word.decode("latin-1")
        s = s[:-1] + chr(ord(s[-1]) + 256)
        n = len(s)
        longest: list[int | None] = [None] * n
        for end, token in self.tokens.iter(s[::-1]):
            # Of the tokens that begin at a place the automaton names the longest first.
            place = n - 1 - end
            if longest[place] is None:
                longest[place] = token
        if self.size.get(longest[0]) == n:
            return [longest[0]]
        size, shorter, known = self.size, self.shorter, self._compatible.get
        out, starts = [], []
        dead = bytearray(n + 1)
        at, last, token = 0, None, longest[0]
        while True:
            while token is not None:
                end = at + size[token]
                if not dead[end]:
                    if last is None:
                        break
                    fits = known(last << 32 | token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is not None:
                if end == n:
                    return [*out, token]
                out.append(token)
                starts.append(at)
                at, last, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = shorter[out.pop()]
                at = starts.pop()
                last = out[-1] if out else None

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = array("i", self.word_ids(word.encode())).tobytes()
            self.words.keep(word, ids)
        return ids

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a piece of text without white space, as 32-bit numbers."""
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk.lower())
        if self.special_pattern is not None and "<" in chunk:
            pieces = self.special_pattern.split(chunk)
        else:
            pieces = [chunk]
        out: list[bytes] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(array("i", [self.special[piece]]).tobytes())
            elif piece:
                # Lower case by single characters: a capital sigma never becomes a final one.
                plain = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                out += map(self._word, _WORD.findall(plain))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, int32."""
        chunks = _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()
        known = self.chunks
        try:
            return np.frombuffer(b"".join([known[c] for c in chunks]), np.int32)
        except KeyError:
            pass
        # What this text needs is at hand whatever the memory forgets meanwhile.
        here = {c: known.get(c) for c in set(chunks)}
        for c, ids in here.items():
            if ids is None:
                here[c] = ids = self.chunk_ids(c)
                known.keep(c, ids)
        return np.frombuffer(b"".join([here[c] for c in chunks]), np.int32)

    def forget(self) -> None:
        """Drops all that is remembered of texts."""
        self.chunks, self.words = Memory(CHUNK_BYTES), Memory(WORD_BYTES)
        self._compatible = {}

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names joined by one space, as a tokenizer without a decoder does, in UTF-8."""
        return gather(ids, *self.names)


def offset_table(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All names in one array, each followed by a space, and where each begins."""
    blob = b"".join(n + b" " for n in names)
    return np.frombuffer(blob, np.uint8), np.concatenate([[0], np.cumsum([len(n) + 1 for n in names])]).astype(np.int64)


def gather(ids: np.ndarray, blob: np.ndarray, starts: np.ndarray, step: int = 1 << 18) -> bytes:
    """The names of ids, joined by one space."""
    out = []
    for k in range(0, len(ids), step):
        part = ids[k : k + step]
        first = starts[part]
        size = starts[part + 1] - first
        ends = np.cumsum(size)
        where = np.repeat((first - (ends - size)).astype(np.int32), size)
        where += np.arange(len(where), dtype=np.int32)
        out.append(blob[where].tobytes())
    return b"".join(out)[:-1]


_loaded: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    """The vocabulary of a file, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def forget() -> None:
    """Drops what the worker's vocabularies remember of texts."""
    for b in _loaded.values():
        b.forget()


def encoded(batches: Iterable[pa.RecordBatch], path: str, rows: int = 500) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """For each few rows (id, text): the ids column and every text's token ids."""
    bpe = codec(path)
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part.column(0), [bpe.encode(t or "") for t in part.column(1).to_pylist()]


def public_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every row's whole text.

    Equals the tokenizers library's encode(text, add_special_tokens=False) and decode(ids, skip_special_tokens=False)
    for the vocabulary file at `path` (present on every executor). A null text is empty; an empty text has no ids and
    an empty decoded text. Repeated rows and null ids are kept as they are; other columns are ignored. Rows are encoded
    independently, in one pass without a shuffle.
    """
    path = path or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, path):
            texts = [codec(path).decode(x) for x in ids]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array([x.decode() for x in texts], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, forget), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the operator's ids and texts, hashed where they are made instead of sent to the JVM."""
    import hashlib

    path = path or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, path):
            bpe = codec(path)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(gather(x, *bpe.decimals)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
