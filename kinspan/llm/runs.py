"""Runs of a batch's bytes as arrays: their hashes, and a bounded table of what is known of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import mix, powers, ranges

#: Values of bytes under two hashes.
_VALUES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(k << 8)) | np.uint64(1) for k in (1, 2)]


class RunTable:
    """Ids of runs by two 64-bit hashes of their bytes, as arrays; bounded in entries."""

    def __init__(self, kind: np.dtype, entries: int):
        self.entries, self.bits = entries, (2 * entries - 1).bit_length()
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.check, self.start, self.size = np.zeros(entries, np.uint64), np.zeros(entries + 1, np.int64), np.zeros(entries, np.int32)
        self.ids = np.zeros(4 * entries, kind)
        self.n = 0

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entries of different runs, -1 where one isn't known."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            held, entry = self.keys[slot], self.entry[slot]
            hit = (held == keys[left]) & (self.check[entry] == check[left])
            out[left[hit]] = entry[hit]
            go = ~hit & (held != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Enters runs that are not known; their entries."""
        flat = np.frombuffer(b"".join(ids), self.ids.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        at = int(self.start[self.n])
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), self.ids.dtype)])
        new = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.ids[at : at + len(flat)] = flat
        self.size[new], self.check[new] = sizes, check
        self.start[self.n + 1 : self.n + 1 + len(ids)] = at + np.cumsum(sizes)
        self.n += len(ids)
        left, slot = np.arange(len(ids)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            # Of several for one slot the last one written stays.
            self.entry[slot[free]] = new[left[free]]
            mine = free & (self.entry[slot] == new[left])
            self.keys[slot[mine]] = keys[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)
        return new

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs one behind the other, and how many each has."""
        size = self.size[entry].astype(np.int64)
        return self.ids[np.repeat(self.start[entry], size) + ranges(size)], size


def different_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and check of the different runs of some bytes, where each first stands among the
    runs, and which of them each run is."""
    forward, back = powers(len(data) + 1)
    hashes = []
    for values in _VALUES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * forward[: len(data)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * back[starts]))
    key, check = hashes[0] | np.uint64(1), hashes[1]
    _, at, which = np.unique(key ^ check, return_index=True, return_inverse=True)
    return key[at], check[at], at, which


def blocks_of(starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about ``size`` bytes each."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + size, "right")))
        yield at, to
        at = to
