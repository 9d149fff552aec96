"""Ids of text units (words), each distinct unit encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ledgerline.llm.textvec import Prefix, mix

#: Distinct units whose ids a worker remembers; others are encoded again when they come up.
CACHE_UNITS = 1 << 20


def signature(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A second hash of each unit, from its length and its first and last eight bytes."""
    head, tail = (stop - begin).astype(np.uint64), np.zeros(len(begin), np.uint64)
    for j in range(8):
        head = head * np.uint64(0xF1357AEA2E62A9C5) + data[np.minimum(begin + j, stop - 1)]
        tail = tail * np.uint64(0xF1357AEA2E62A9C5) + data[np.maximum(stop - 1 - j, begin)]
    return mix(head) + tail


class KnownUnits:
    """Open-addressing table from a unit's two 64-bit hashes to its ids in a pool."""

    def __init__(self, capacity: int = CACHE_UNITS):
        self.capacity, self.count = capacity, 0
        self.bits = (2 * capacity - 1).bit_length()
        n = 1 << self.bits
        self.key, self.sign = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.start, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Slots of the units, -1 for unknown ones. Keys are never zero."""
        out, left, slot = np.full(len(key), -1), np.arange(len(key)), self._slot(key)
        while len(left):
            there = self.key[slot]
            hit = (there == key[left]) & (self.sign[slot] == sign[left])
            out[left[hit]] = slot[hit]
            more = ~hit & (there != 0)
            left, slot = left[more], (slot[more] + 1) & (len(self.key) - 1)
        return out

    def add(self, key: np.ndarray, sign: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Remember distinct unknown units; beyond the capacity they are left out."""
        n = min(len(key), self.capacity - self.count)
        left, slot = np.arange(n), self._slot(key[:n])
        self.count += n
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[left[free]]
            self.sign[slot[free]] = sign[left[free]]
            won = (self.key[slot] == key[left]) & (self.sign[slot] == sign[left])
            self.start[slot[won]], self.size[slot[won]] = start[left[won]], size[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.key) - 1)

    def append(self, ids: np.ndarray) -> int:
        """Put ids behind the pool's end (not yet kept); returns where."""
        need = self.used + len(ids)
        if need > len(self.pool):
            grown = np.zeros(2 * need, np.uint16)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : need] = ids
        return self.used


class UnitCache:
    """Looks units up by their bytes and encodes the unknown ones, many at a time."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], capacity: int = CACHE_UNITS):
        self._encode = encode  # words -> ids on end, and how many each word has
        self.known = KnownUnits(capacity)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units data[start:end] on end, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        hashes = mix(Prefix(data).of(starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1)
        key, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        begin, stop = starts[first], ends[first]
        sign = signature(data, begin, stop)
        known = self.known
        slot = known.find(key, sign)
        start, size = known.start[slot].astype(np.int64), known.size[slot].astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            flat = data.tobytes()
            ids, each = self._encode([flat[a:b].decode() for a, b in zip(begin[new].tolist(), stop[new].tolist())])
            at = known.append(ids)
            start[new], size[new] = at + np.cumsum(each) - each, each
            kept = min(len(new), known.capacity - known.count)
            known.add(key[new], sign[new], start[new], size[new])
            known.used += int(each[:kept].sum())
        each = size[unit]
        return known.pool[np.repeat(start[unit] - (np.cumsum(each) - each), each) + np.arange(each.sum())], each
