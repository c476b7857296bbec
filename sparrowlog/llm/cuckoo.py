"""A cuckoo filter over 64-bit hashes: approximate set with insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class CuckooFilter:
    """Buckets of four 16-bit tags (0: free).  A tag may lie in either of two buckets.

    Insert a key once and delete only keys that were inserted: then no key
    held is ever missed, and others are taken for held at about 8 / 65,536.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.8))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        tags = (hashes >> np.uint64(48)).astype(np.uint16)
        tags[tags == 0] = 1
        first = _mix(hashes) & mask
        return tags, first.astype(np.int64), ((first ^ _mix(tags.astype(np.uint64))) & mask).astype(np.int64)

    def _other(self, bucket: int, tag: int) -> int:
        return int((np.uint64(bucket) ^ _mix(np.array([tag], np.uint64))[0]) & np.uint64(len(self.table) - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        tags, a, b = self._places(hashes)
        return (self.table[a] == tags[:, None]).any(axis=1) | (self.table[b] == tags[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if it is too full; then build a larger one from the exact table."""
        rng = np.random.default_rng(0)
        for tag, a, b in zip(*(x.tolist() for x in self._places(hashes))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = tag
                    break
            else:
                at = a
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    self.table[at, slot], tag = tag, int(self.table[at, slot])
                    at = self._other(at, tag)
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = tag
                        break
                else:
                    return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        for tag, a, b in zip(*(x.tolist() for x in self._places(hashes))):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == tag)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, body: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(body, np.uint16).reshape(-1, SLOTS).copy())


def built(hashes: np.ndarray, capacity: int = 0) -> CuckooFilter:
    """A filter of these keys, as large as it needs to be."""
    size = max(capacity, len(hashes), 8)
    while True:
        f = CuckooFilter(size)
        if f.insert(hashes):
            return f
        size *= 2
