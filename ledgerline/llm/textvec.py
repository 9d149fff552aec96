"""Vectorised views of a batch of texts: bytes, words, lines and their hashes.

All texts of a slice lie in one byte array. A polynomial hash of any byte range
comes from two entries of a prefix array: with ``S[i] = sum(code[c_j] * r**j,
j < i)`` modulo 2**64 and odd ``r``, the range [a, b) hashes to
``(S[b] - S[a]) * r**-a``, wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RATIOS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, for two independent hashes
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_codes = {k: np.random.default_rng(k).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1) for k in (0, 1)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end (null: empty) and the offsets between them."""
    texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of every bit over the word (a bijection)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        r = _RATIOS[kind]
        inverse = pow(r, -1, 1 << 64)
        size = max(n, 1 << 16)
        up = np.full(size, r, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 1 << 22:  # tables of an unusually long text are not kept
            _powers[kind] = have
    return have


class Prefix:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, self._down = _power(kind, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_codes[kind][data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [starts, ends), not mixed."""
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte ranges, by start."""
        n = len(self._sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self._sums[k:] - self._sums[:n]) * self._down[:n]


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many entries of a byte mask are set in each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``inside`` within texts."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(word_hash: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which ``size`` words of one text start, and their mixed hashes."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    made = np.zeros(n, np.uint64)
    for j in range(size):
        made = made * _U(0x9FB21C651E98DF25) + word_hash[j : j + n]
    return at, mix(made[at])
