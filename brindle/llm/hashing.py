"""Hashes of words, word shingles and byte strings for whole batches of texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

# Odd multipliers of the mixing step (a public 64-bit finaliser) and of the polynomials.
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SHINGLE_BASE = 0xA0761D6478BD642F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are mixed in numpy, a step for each eight of them.
LONG_WORD = 256
#: Lower case of A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


_made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2^64, at least `size` of each, and a random value for each byte. A worker keeps the longest it has made."""
    if base in _made and len(_made[base][0]) >= size:
        return _made[base]
    size = 1 << max(16, int(size - 1).bit_length())
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    up[0] = down[0] = 1
    n = 1
    while n < size:
        k = min(n, size - n)
        up[n : n + k] = up[:k] * np.uint64(pow(base, n, 1 << 64))
        down[n : n + k] = down[:k] * np.uint64(pow(inverse, n, 1 << 64))
        n += k
    _made[base] = up, down, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    return _made[base]


def forget() -> None:
    """Drops the powers that the worker keeps."""
    _made.clear()


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """Polynomial sums of the bytes before each place: len(data) + 1 numbers."""
    up, _, value = powers(base, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of data[start:end] from prefix_hash, equal for equal bytes wherever they stand."""
    _, down, _ = powers(base, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, and where each text's words begin in them (len(texts) + 1).

    A word is mixed eight bytes at a time, in order, with its length; one of more than LONG_WORD bytes is hashed by BLAKE2.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer((joined.translate(LOWER) if lower else joined) + b"\0" * 8, np.uint8)
    space = _SPACE[data[:-8]]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # Every place's next eight bytes as one number, without a copy.
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    size = ends - starts
    hashes = mix(size.astype(np.uint64) * _MIX_A)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    on = np.flatnonzero(size <= LONG_WORD)
    at = starts[on]
    while len(on):
        left = size[on] - (at - starts[on])
        piece = np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
        short = left < 8
        piece[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        hashes[on] = mix((hashes[on] ^ mix(piece + _MIX_B)) * _MIX_A)
        more = left > 8
        on, at = on[more], at[more] + 8
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(starts, text_starts)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words as sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
    words, bounds = word_hashes(texts)
    n = len(words)
    coefficients = [pow(_SHINGLE_BASE, k + 1, 1 << 64) for k in range(width)]
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k, c in enumerate(coefficients):
        whole += words[k : k + len(whole)] * np.uint64(c)
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(_short(words[a:b], coefficients))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _short(words: np.ndarray, coefficients: list[int]) -> np.ndarray:
    total = sum(int(w) * c for w, c in zip(words.tolist(), coefficients)) + len(words)
    return mix(np.array([total % (1 << 64)], np.uint64))
