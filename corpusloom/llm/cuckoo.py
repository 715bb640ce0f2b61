"""A cuckoo filter over 128-bit keys, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """16-bit tags in buckets of four; a key has two buckets, each found from the other by its tag.

    add() and remove() take one key (two 64-bit integers), contains() arrays of keys. A filter has no false negatives;
    removing a key that was never added would break that, so callers back it with exact counts.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self._kick = 0

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        """An empty filter that n keys fill to at most three quarters."""
        buckets = 1
        while buckets * SLOTS * 3 < n * 4:
            buckets *= 2
        return cls(buckets)

    @staticmethod
    def _tags(high: np.ndarray) -> np.ndarray:
        return (high.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.int64)

    @staticmethod
    def _spread(tags: np.ndarray | int):
        return tags * 0x5BD1E995 & 0x7FFFFFFF

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag, first and second bucket of keys."""
        tags = self._tags(high.view(np.uint64))
        first = (low.view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
        return tags, first, first ^ (self._spread(tags) & self.buckets - 1)

    def contains(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        tags, first, second = self.places(low, high)
        tags = tags.astype(np.uint16)[:, None]
        return (self.table[first] == tags).any(axis=1) | (self.table[second] == tags).any(axis=1)

    def _put(self, bucket: int, tag: int) -> bool:
        row = self.table[bucket]
        for slot in range(SLOTS):
            if not row[slot]:
                row[slot] = tag
                return True
        return False

    def add(self, tag: int, first: int, second: int) -> bool:
        """False: full; the caller builds a larger filter from the exact table."""
        if self._put(first, tag) or self._put(second, tag):
            return True
        bucket = second
        moves = []
        for _ in range(KICKS):
            slot = self._kick % SLOTS
            self._kick += 1
            moves.append((bucket, slot, tag))
            tag, self.table[bucket, slot] = int(self.table[bucket, slot]), tag
            bucket ^= self._spread(tag) & self.buckets - 1
            if self._put(bucket, tag):
                return True
        for bucket, slot, _ in reversed(moves):  # undo, so that what was there is still found
            tag, self.table[bucket, slot] = int(self.table[bucket, slot]), tag
        return False

    def remove(self, tag: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            at = np.flatnonzero(self.table[bucket] == tag)
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False

    def add_all(self, low: np.ndarray, high: np.ndarray) -> bool:
        return all(self.add(t, a, b) for t, a, b in zip(*(x.tolist() for x in self.places(low, high))))

    def remove_all(self, low: np.ndarray, high: np.ndarray) -> None:
        for t, a, b in zip(*(x.tolist() for x in self.places(low, high))):
            self.remove(t, a, b)

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, room: int = 0) -> "CuckooFilter":
        """A filter of these distinct keys, with room for at least as many more as given."""
        n = len(low) + room
        while True:
            made = cls.for_keys(max(n, 1))
            if made.add_all(low, high):
                return made
            n = max(2 * n, made.buckets * SLOTS)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)
