"""A cuckoo filter over 64-bit keys: membership without misses, insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Each key leaves a 16-bit fingerprint in one of two buckets; the table doubles when it gets full.

    Keys are kept out of the filter: growing it needs them again, so a caller that `insert` tells of lost keys makes a
    filter of all keys by `CuckooFilter.build`.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def build(cls, keys: np.ndarray, room: int = 0) -> "CuckooFilter":
        """A filter of distinct keys, at most four fifths full, that has room for so many keys in all."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys), room) / (SLOTS * 0.8)))))
        while True:
            made = cls(buckets)
            if not len(made.insert(keys)):
                return made
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mixed(keys.astype(np.uint64))
        prints = ((mixed >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (mixed & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = _mixed(prints.astype(np.uint64) + np.uint64(1)) & np.uint64(self.buckets - 1)
        return bucket ^ step.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        held = self.table[first] == prints[:, None]
        return held.any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds keys; returns the positions of those that found no place (then the filter must be rebuilt)."""
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for home in (first, second):
            left = self._settle(prints, home, left)
        lost = [at for at in left.tolist() if not self._kick(int(second[at]), int(prints[at]))]
        return np.array(lost, np.int64)

    def _settle(self, prints: np.ndarray, home: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Puts what fits into the free slots of its bucket, all buckets at once."""
        order = left[np.argsort(home[left], kind="stable")]
        bucket = home[order]
        rank = np.arange(len(order)) - np.searchsorted(bucket, bucket)
        used = (self.table[bucket] != 0).sum(1)
        fits = rank + used < SLOTS
        # Slots fill from the left, and a deletion closes the gap it leaves.
        self.table[bucket[fits], (used + rank)[fits]] = prints[order[fits]]
        return order[~fits]

    def _kick(self, bucket: int, print_: int) -> bool:
        """Moves fingerprints to their other bucket until one finds a free slot; undone if none does in 500 moves."""
        moved = []
        for turn in range(500):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = print_
                return True
            slot = turn % SLOTS
            moved.append((bucket, slot, int(row[slot])))
            row[slot], print_ = print_, int(row[slot])
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        for bucket, slot, old in reversed(moved):
            self.table[bucket, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes one fingerprint out per key; the keys must be in the filter."""
        prints, first, second = self._places(keys)
        for print_, *homes in zip(prints.tolist(), first.tolist(), second.tolist()):
            for bucket in homes:
                slots = np.flatnonzero(self.table[bucket] == print_)
                if len(slots):
                    row = self.table[bucket]
                    row[slots[0]:-1] = row[slots[0] + 1:].copy()
                    row[-1] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)
