"""A cuckoo filter over 128-bit keys, vectorised in numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 400


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; every key has two buckets.

    Keys are pairs of 64-bit halves of a 128-bit hash.  A key is to be
    inserted once (the exact table beside the filter knows which keys are
    in), so that a removal takes out exactly what one insertion put in.
    Keys that find no slot after ``MAX_KICKS`` moves are kept whole in
    ``stash``: nothing is ever lost, whatever the load.
    """

    def __init__(self, table: np.ndarray, stash: set[tuple[int, int]]):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, n_keys: int) -> "CuckooFilter":
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), set())

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        fp = (k2 >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        b1 = (k1 >> np.uint64(16)) & mask
        return fp, b1.astype(np.int64), self._other(b1, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        jump = (fp.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)
        return (bucket.astype(np.uint64) ^ jump).astype(np.int64)

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; False where full."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.searchsorted(b, b, side="left")
        rank = np.arange(len(b)) - first
        free = self.table[b] == 0
        fits = rank < free.sum(axis=1)
        # the rank-th free slot of the bucket
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
        self.table[b[fits], slot[fits]] = fp[order][fits]
        done = np.zeros(len(b), bool)
        done[order] = fits
        return done

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        fp, b1, b2 = self._places(k1, k2)
        left = np.flatnonzero(~self._fill(b1, fp))
        left = left[~self._fill(b2[left], fp[left])]
        rng = np.random.default_rng(1)
        for i in left:
            path, bucket, f = [], int(b2[i]), fp[i]
            for _ in range(MAX_KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = f
                    break
                slot = int(rng.integers(SLOTS))
                path.append((bucket, slot, f))
                f, self.table[bucket, slot] = self.table[bucket, slot], f
                bucket = int(self._other(np.array([bucket]), np.array([f], np.uint16))[0])
            else:
                for bucket, slot, mine in reversed(path):  # undo the moves
                    f, self.table[bucket, slot] = self.table[bucket, slot], f
                self.stash.add((int(k1[i]), int(k2[i])))

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        fp, b1, b2 = self._places(k1, k2)
        for i in range(len(fp)):
            key = (int(k1[i]), int(k2[i]))
            if key in self.stash:
                self.stash.discard(key)
                continue
            for bucket in (b1[i], b2[i]):
                at = np.flatnonzero(self.table[bucket] == fp[i])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, b1, b2 = self._places(k1, k2)
        hit = (self.table[b1] == fp[:, None]).any(axis=1) | (self.table[b2] == fp[:, None]).any(axis=1)
        if self.stash:
            hit |= np.fromiter(((int(a), int(b)) in self.stash for a, b in zip(k1, k2)), bool, len(k1))
        return hit

    def to_bytes(self) -> bytes:
        stash = np.array(sorted(self.stash), np.uint64).reshape(-1, 2)
        return np.uint64(len(stash)).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        stash = np.frombuffer(data, np.uint64, 2 * n, 8).reshape(-1, 2)
        table = np.frombuffer(data, np.uint16, offset=8 + 16 * n).reshape(-1, SLOTS).copy()
        return cls(table, {(int(a), int(b)) for a, b in stash})
