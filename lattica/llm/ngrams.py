"""Vectorised word n-gram hashing shared by the n-gram operators.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text;
everything else separates words.  Texts are hashed many at a time: a polynomial prefix hash over the
bytes gives every word's hash without a Python loop over words, and every n-gram's hash is a mix of its
words' hashes.
"""

from __future__ import annotations

import numpy as np

from .shared import CACHES

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CACHES.append(_POWERS.clear)
#: Lower-case word bytes; upper case is folded here only for ASCII (texts come lower-cased).
_IS_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)], dtype=bool)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64)
            for p in (_P, _P_INV)
        )
    return _POWERS[size]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of a lower-cased UTF-8 byte array."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=total[1:])
    return start, mix64((total[end] - total[start]) * inverse[start])


def ngram_hashes(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all word n-grams of documents that lie one after another in ``data``.

    Document i is ``data[bounds[i]:bounds[i + 1]]`` and must end with a separator byte.  A document with
    fewer than ``n`` words, but at least one, has one n-gram, of all its words.  Repeats are kept.
    """
    start, words = word_hashes(data)
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    grams = np.zeros(len(words), np.uint64)
    left = first[doc + 1] - np.arange(len(words)) if len(words) else np.empty(0, np.int64)
    for j in range(n):
        part = mix64(words[j:] + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        grams[: len(part)] += np.where(left[: len(part)] > j, part, np.uint64(0))
    short = (count > 0) & (count < n)
    keep = left >= n
    keep[first[:-1][short]] = True
    return doc[keep], mix64(grams[keep])


def chunks(texts, limit: int = 2_000_000):
    """Cut (position, lower-cased text bytes) pairs into runs of about ``limit`` bytes, as arrays for ngram_hashes."""
    at, parts, size = [], [], 0
    for position, text in texts:
        if parts and size + len(text) > limit:
            yield _pack(at, parts)
            at, parts, size = [], [], 0
        at.append(position)
        parts.append(text)
        size += len(text) + 1
    if parts:
        yield _pack(at, parts)


def _pack(at, parts):
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return at, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), bounds
