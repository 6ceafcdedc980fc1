"""A minimal perfect hash over distinct 128-bit keys, as flat arrays.

Every level has a bit per place for the keys that are left. A place that exactly one key falls on gets its bit and the
key is done; keys that share a place go on to the next level. A key's slot is the number of bits before its own.
"""

from __future__ import annotations

import numpy as np

ROOM = 1.5


def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> "PerfectHash":
        """The keys must differ."""
        sizes, bits = [], []
        while len(high):
            size = int(len(high) * ROOM) + 1
            place = _place(high, low, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = ~alone[place]
            high, low = high[rest], low[rest]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *bits]))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 or any slot for keys that it was not built over."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _place(high[left], low[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes) -> "PerfectHash":
        own = np.frombuffer(sizes, np.int64)
        return cls(own, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(own.sum())).astype(bool))
