"""Cuckoo filters over 128-bit digests, in numpy: whole arrays of keys are looked up, inserted and removed at once.

A filter is a table of buckets of four 16-bit marks. A key's mark may lie in
either of two buckets, each computable from the other and the mark. What finds
no place goes into an exact list, the stash, so a filter never forgets a key;
a key whose marks match by chance is told apart by the exact table behind it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SLOTS = 4
#: Rounds in which marks are moved to their other bucket before the stash takes them.
MOVES = 64


def _marks(second: np.ndarray) -> np.ndarray:
    return ((second.view(np.uint64) >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The position of each element among the equal ones."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    starts = np.r_[True, ordered[1:] != ordered[:-1]]
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(groups)), 0))
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - begin
    return out


@dataclass
class Cuckoo:
    table: np.ndarray
    #: Keys without a place, two numbers each.
    stash: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        """An empty filter with room for twice as many keys."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, 2 * keys) / SLOTS))))
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def from_bytes(table: bytes, stash: bytes) -> Cuckoo:
        return Cuckoo(np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.int64).reshape(-1, 2).copy())

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.stash.tobytes()

    def _home(self, first: np.ndarray) -> np.ndarray:
        return (first.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
        mixed = (marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return at ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _stashed(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.stash):
            return np.zeros(len(keys), bool)
        held = set(map(tuple, self.stash.tolist()))
        return np.array([tuple(k) in held for k in keys.tolist()], bool)

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each key may have been inserted; false is certain."""
        marks, home = _marks(second), self._home(first)
        found = (self.table[home] == marks[:, None]).any(1) | (self.table[self._other(home, marks)] == marks[:, None]).any(1)
        if len(self.stash):
            found |= self._stashed(np.stack([first, second], 1))
        return found

    def _place(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; true where that was possible."""
        rank = _ranks(at)
        free = self.table[at] == 0
        fits = rank < free.sum(1)
        slots = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
        self.table[at[fits], slots[fits]] = marks[fits]
        return fits

    def insert(self, first: np.ndarray, second: np.ndarray) -> None:
        """Insert keys; each only once."""
        if not len(first):
            return
        marks, home = _marks(second), self._home(first)
        left = np.flatnonzero(~self._place(marks, home))
        left = left[~self._place(marks[left], self._other(home[left], marks[left]))] if len(left) else left
        for k in left:
            if not self._move(int(home[k]), marks[k], int(k)):
                self.stash = np.vstack([self.stash, [[first[k], second[k]]]])

    def _move(self, at: int, mark: np.uint16, turn: int) -> bool:
        """Place one mark by moving others on; false, and nothing moved, if that takes too long."""
        done: list[tuple[int, int, np.uint16]] = []
        for step in range(MOVES):
            bucket = self.table[at]
            free = np.flatnonzero(bucket == 0)
            if len(free):
                bucket[free[0]] = mark
                return True
            slot = (turn + step * 7) % SLOTS
            done.append((at, slot, bucket[slot]))
            bucket[slot], mark = mark, bucket[slot]
            at = int(self._other(np.array([at]), np.array([mark], np.uint16))[0])
        for where, slot, was in reversed(done):
            self.table[where, slot] = was
        return False

    def remove(self, first: np.ndarray, second: np.ndarray) -> None:
        """Remove keys that were inserted; the caller knows that from the exact table."""
        if not len(first):
            return
        keys = np.stack([first, second], 1)
        stashed = self._stashed(keys)
        if stashed.any():
            gone = set(map(tuple, keys[stashed].tolist()))
            self.stash = np.array([k for k in self.stash.tolist() if tuple(k) not in gone], np.int64).reshape(-1, 2)
            first, second = first[~stashed], second[~stashed]
        marks, home = _marks(second), self._home(first)
        other = self._other(home, marks)
        rank = _ranks(np.minimum(home, other) * 65536 + marks)
        for r in range(int(rank.max()) + 1 if len(rank) else 0):
            now = np.flatnonzero(rank == r)
            for at in (home, other):
                hit = self.table[at[now]] == marks[now, None]
                found = hit.any(1)
                self.table[at[now][found], hit[found].argmax(1)] = 0
                now = now[~found]

    def load(self) -> float:
        return float((self.table != 0).mean())
