"""A minimal perfect hash of distinct 64-bit keys, with a count for each key.

Levels of bits: at each level the keys left over fall into twice as many places; a key alone in its
place keeps it, the others go down a level. A key's number is the count of kept places before its
own, so n keys have the numbers 0 to n-1, at about four bits a key. Keys that were never in the set get
a number as well, or -1; `keys`, in the order of the numbers, tell them apart.
"""

from __future__ import annotations

import numpy as np

from lakewarden.llm.text import mix

SPREAD = 2  # places a key at each level
_SEED = 500


class PerfectHash:
    """Built from distinct keys; or from bytes, as written by `to_bytes`."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = [np.cumsum(kept) for kept in levels]
        before = np.cumsum([0, *(int(s[-1]) for s in sums)])
        self.size = int(before[-1])
        # Number of a kept place: kept places before it, over all levels.
        self.ranks = [s + b - 1 for s, b in zip(sums, before, strict=False)]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, _SEED + level) % np.uint64(size)).astype(np.int64)

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        left = keys
        while len(left):
            size = max(8, SPREAD * len(left))
            at = cls._places(left, len(levels), size)
            kept = np.bincount(at, minlength=size) == 1
            levels.append(kept)
            left = left[~kept[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (kept, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._places(keys[open_], level, len(kept))
            hit = kept[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def ordered(self, keys: np.ndarray) -> np.ndarray:
        """The keys of the set by ascending number."""
        out = np.empty(self.size, dtype=np.uint64)
        out[self.numbers(keys)] = keys
        return out

    def verified(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Numbers of keys that must be in the set; `known` holds the keys by number."""
        numbers = self.numbers(keys)
        if len(keys) and (not self.size or numbers.min() < 0 or (known[numbers] != keys).any()):
            raise ValueError("a key is not in the set that was hashed")
        return numbers

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype=np.int64)
        return sizes.tobytes() + b"".join(np.packbits(kept).tobytes() for kept in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
        sizes = np.frombuffer(blob, dtype=np.int64, count=n, offset=8)
        levels, at = [], 8 + 8 * n
        for size in sizes.tolist():
            width = -(-size // 8)
            part = np.frombuffer(blob, dtype=np.uint8, count=width, offset=at)
            levels.append(np.unpackbits(part, count=size).astype(bool))
            at += width
        return cls(levels)
