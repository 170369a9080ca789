"""Count-min sketches of 64-bit keys, merged shard by shard, to tell which keys may be repeated.

No task ever holds the whole sketch. The key's first bits name its shard. A batch of documents sends
each shard its partial sketch: for each of DEPTH rows the sorted cells its distinct keys fall into,
as differences, with a flag where a cell counts more than once in the batch. The shard adds up the
partial sketches of all batches (counters stop at two, since only "once" and "more" matter) and
answers each batch, for each of its cells, whether the total is more than one. The batch takes the
least answer over the rows: an estimate that is never below the truth, so no repeated key is lost.

A shard has 2**CELL_BITS cells a row and is laid out for a quarter as many keys, so about one in
twenty keys that occur once is taken for repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lakewarden.llm.text import mix

CELL_BITS = 24
DEPTH = 2
_FAR = np.uint16(0xFFFF)


def packed_cells(cells: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as 16-bit differences; larger ones follow in full."""
    steps = np.diff(cells.astype(np.int64), prepend=0)
    far = steps >= _FAR
    near = np.where(far, _FAR, steps).astype("<u2")
    return np.int64(len(cells)).tobytes() + near.tobytes() + steps[far].astype("<u4").tobytes()


def opened_cells(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    steps = np.frombuffer(blob, dtype="<u2", count=n, offset=8).astype(np.int64)
    steps[steps == _FAR] = np.frombuffer(blob, dtype="<u4", offset=8 + 2 * n)
    return np.cumsum(steps)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


@dataclass(frozen=True)
class Sketch:
    """The layout: 2**shard_bits shards."""

    shard_bits: int
    cell_bits: int = CELL_BITS
    depth: int = DEPTH

    @classmethod
    def for_keys(cls, keys: int, cell_bits: int = CELL_BITS, depth: int = DEPTH,
                 spare_bits: int = 2) -> Sketch:
        """Shards for so many keys, with 2**spare_bits cells a key (once more at worst)."""
        shard_bits = max(0, int(keys - 1).bit_length() - (cell_bits - spare_bits))
        return cls(shard_bits, cell_bits, depth)

    def parts(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """Shard, begin and end of the keys (ascending) that lie in each shard that has any."""
        if not self.shard_bits:
            return [(0, 0, len(keys))] if len(keys) else []
        shards = (keys >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(shards)) + 1
        begins = [0, *edges.tolist()] if len(keys) else []
        ends = [*edges.tolist(), len(keys)]
        return [(int(shards[a]), a, b) for a, b in zip(begins, ends, strict=False)]

    def _cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        shift = np.uint64(64 - self.cell_bits)
        if row == 0:
            return (keys << np.uint64(self.shard_bits)) >> shift
        return mix(keys, 100 + row) >> shift

    def partial(self, keys: np.ndarray, many: np.ndarray) -> list[tuple[int, list[bytes]]]:
        """The batch's part for each shard; `many`: keys that occur more than once in the batch."""
        out = []
        for shard, a, b in self.parts(keys):
            blobs = []
            for row in range(self.depth):
                cells, back = np.unique(self._cells(keys[a:b], row), return_inverse=True)
                counts = np.bincount(back) > 1
                counts[back[many[a:b]]] = True
                blobs += [packed_cells(cells), bits(counts)]
            out.append((shard, blobs))
        return out

    def merged(self, parts: list[list[bytes]]) -> list[list[bytes]]:
        """For one shard: the answers to each batch, a blob of bits per row."""
        answers: list[list[bytes]] = [[] for _ in parts]
        for row in range(self.depth):
            once = np.zeros(1 << self.cell_bits, dtype=bool)
            more = np.zeros(1 << self.cell_bits, dtype=bool)
            for blobs in parts:
                cells = opened_cells(blobs[2 * row])
                more[cells] |= once[cells] | flags(blobs[2 * row + 1], len(cells))
                once[cells] = True
            for blobs, answer in zip(parts, answers, strict=True):
                answer.append(bits(more[opened_cells(blobs[2 * row])]))
        return answers

    def repeated(self, keys: np.ndarray, answers: dict[int, list[bytes]]) -> np.ndarray:
        """Which keys of a batch may be repeated, by the shards' answers."""
        out = np.ones(len(keys), dtype=bool)
        for shard, a, b in self.parts(keys):
            for row in range(self.depth):
                cells, back = np.unique(self._cells(keys[a:b], row), return_inverse=True)
                out[a:b] &= flags(answers[shard][row], len(cells))[back]
        return out
