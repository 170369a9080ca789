"""Counting quotient filters of n-grams: compact, lossless, mergeable.

An n-gram of word ids is packed into one number of `width` bits and permuted by a Feistel network, one
to one, so that any set of n-grams is spread evenly. Of a permuted number the first bits name a shard,
the next `q` bits are the quotient and all others the remainder, which is kept in full: numbers
come back exactly. A filter holds its entries by ascending number as

* for each quotient, in unary, how many entries it has (a one for each, then a zero),
* the remainders in whole bytes (q is chosen so that they fill these),
* a bit for each entry that says whether it counts more than one, and the counts of these.

Numbers of more than 64 bits are held as two halves, `high` and `low`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lakewarden.llm.text import mix

_ROUNDS = 4
_SEED = 900


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Layout:
    """How n-grams of `n` words, with ids of `id_bits` bits, lie in a number.

    The lower half has whole bytes. Ids have at most 32 bits, so a half has at most 56.
    """

    n: int
    id_bits: int  # 8 at least

    @property
    def low_bits(self) -> int:
        return 8 * max(1, self.n * self.id_bits // 16)

    @property
    def high_bits(self) -> int:
        return self.n * self.id_bits - self.low_bits

    def packed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids to permuted numbers."""
        high, low = np.zeros(len(ids), dtype=np.uint64), np.zeros(len(ids), dtype=np.uint64)
        for column in ids.astype(np.uint64).T:  # as one long number, shifted left by an id each time
            carried = low >> np.uint64(max(0, self.low_bits - self.id_bits))
            if self.low_bits >= self.id_bits:
                high = (high << np.uint64(self.id_bits)) | carried
                low = ((low << np.uint64(self.id_bits)) | column) & _mask(self.low_bits)
            else:  # an id is wider than the lower half
                whole = (low << np.uint64(self.id_bits)) | column
                high = (high << np.uint64(self.id_bits)) | (whole >> np.uint64(self.low_bits))
                low = whole & _mask(self.low_bits)
        for r in range(_ROUNDS):
            low = low ^ (mix(high, _SEED + 2 * r) & _mask(self.low_bits))
            high = high ^ (mix(low, _SEED + 2 * r + 1) & _mask(self.high_bits))
        return high, low

    def unpacked(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        for r in reversed(range(_ROUNDS)):
            high = high ^ (mix(low, _SEED + 2 * r + 1) & _mask(self.high_bits))
            low = low ^ (mix(high, _SEED + 2 * r) & _mask(self.low_bits))
        out = np.empty((len(high), self.n), dtype=np.int64)
        for i in reversed(range(self.n)):
            # The lowest id, then everything shifted right by it.
            if self.low_bits >= self.id_bits:
                out[:, i] = (low & _mask(self.id_bits)).astype(np.int64)
                low = (low >> np.uint64(self.id_bits)) | (
                    (high & _mask(self.id_bits)) << np.uint64(self.low_bits - self.id_bits))
                high = high >> np.uint64(self.id_bits)
            else:
                whole = ((high & _mask(self.id_bits)) << np.uint64(self.low_bits)) | low
                out[:, i] = (whole & _mask(self.id_bits)).astype(np.int64)
                high = high >> np.uint64(self.id_bits)
                low = (whole >> np.uint64(self.id_bits)) & _mask(self.low_bits)
        return out


def distinct(layout: Layout, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers ascending, each once, with their counts added up (at first 1 each)."""
    if layout.n * layout.id_bits > 64:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    else:  # a number fits one value, and sorting values alone is faster
        shift = np.uint64(layout.low_bits)
        whole = (high << shift) | low
        if counts is None:
            whole.sort()
        else:
            order = np.argsort(whole)
            whole = whole[order]
        high, low = whole >> shift, whole & _mask(layout.low_bits)
    new = np.ones(len(high), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    if counts is None:
        total = np.diff(at, append=len(high))
    else:
        total = np.add.reduceat(counts[order], at) if len(at) else np.empty(0, dtype=np.int64)
    return high[at], low[at], total


def _whole_bytes(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :bits // 8].tobytes()


def _from_bytes(blob: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :bits // 8] = np.frombuffer(blob, dtype=np.uint8, count=n * bits // 8).reshape(n, bits // 8)
    return out.reshape(-1).view("<u8")


def to_filter(layout: Layout, shard_bits: int, high: np.ndarray, low: np.ndarray,
              counts: np.ndarray) -> bytes:
    """The filter of a shard's distinct numbers, ascending."""
    n, free = len(high), layout.high_bits - shard_bits
    # About as many quotients as entries; what is left of the upper half fills whole bytes.
    q = min(free, int(n).bit_length())
    q -= (q - free) % 8
    q = q if q >= 0 else free % 8
    rest = free - q
    own = high & _mask(free)
    sizes = np.bincount((own >> np.uint64(rest)).astype(np.int64), minlength=1 << q)
    unary = np.ones(n + (1 << q), dtype=np.uint8)
    unary[np.cumsum(sizes + 1) - 1] = 0
    many = counts > 1
    header = np.array([n, q, int(many.sum())], dtype=np.int64)
    return b"".join((header.tobytes(), np.packbits(unary).tobytes(), _whole_bytes(own, rest),
                     _whole_bytes(low, layout.low_bits), np.packbits(many).tobytes(),
                     counts[many].astype("<i8").tobytes()))


def from_filter(layout: Layout, shard_bits: int, shard: int, blob: bytes
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, q, n_many = np.frombuffer(blob, dtype=np.int64, count=3).tolist()
    free = layout.high_bits - shard_bits
    rest = free - q
    view, at = memoryview(blob), 24
    size = n + (1 << q)
    unary = np.unpackbits(np.frombuffer(view, np.uint8, -(-size // 8), at), count=size)
    at += -(-size // 8)
    ones = np.flatnonzero(unary)
    quotient = (ones - np.arange(n)).astype(np.uint64)  # zeros before an entry
    own = _from_bytes(view[at:], n, rest)
    at += n * rest // 8
    low = _from_bytes(view[at:], n, layout.low_bits)
    at += n * layout.low_bits // 8
    many = np.unpackbits(np.frombuffer(view, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    counts = np.ones(n, dtype=np.int64)
    counts[many] = np.frombuffer(view, "<i8", n_many, at)
    high = own | (quotient << np.uint64(rest)) | (np.uint64(shard) << np.uint64(free))
    return high, low, counts


def split(layout: Layout, shard_bits: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray
          ) -> list[tuple[int, bytes]]:
    """A filter for each shard that the numbers (ascending) fall into."""
    if not len(high):
        return []
    shards = (high >> np.uint64(layout.high_bits - shard_bits)).astype(np.int64)
    found, begin = np.unique(shards, return_index=True)
    ends = [*begin[1:].tolist(), len(high)]
    return [(s, to_filter(layout, shard_bits, high[a:b], low[a:b], counts[a:b]))
            for s, a, b in zip(found.tolist(), begin.tolist(), ends, strict=True)]


def merged(layout: Layout, shard_bits: int, shard: int, blobs: list[bytes]
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of a shard's filters."""
    parts = [from_filter(layout, shard_bits, shard, b) for b in blobs]
    return distinct(layout, *(np.concatenate(c) for c in zip(*parts, strict=True)))
