"""Packing documents into windows of equal capacity by Karmarkar-Karp multiway differencing.

1. Every document is encoded and cut: windows it fills alone first, the rest into pieces of at most
   PIECE ids. Pieces are written with a number of their own, so that later steps repeat their answer.
2. Short pieces are dealt to groups of about GROUP by a hash of that number. A group fills
   k = ceil(ids / capacity) windows by differencing: each piece is a partition of its own with k - 1
   empty windows; the two partitions with the widest spread between their fullest and emptiest
   window are merged, the fullest window of one with the emptiest of the other, until one is left.
   If a window then holds more than the capacity, k rises by one and the group starts again; at
   one piece a window it always fits.
3. Windows filled by one piece need no group.

Windows come out nearly equal, and since PIECE is a quarter of the capacity they come out nearly
full. A group is a few hundred kilobytes whatever the size of the table or of a document.

Defined results: a null or empty text is one piece with the end id alone. Rows that share a doc_id,
copies included, are packed one by one. Rows without doc_id are packed too. Extra columns are ignored.
An empty table has no windows. Numbers of windows are unique, not gapless.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.byte_bpe import ByteEncoder
from lakewarden.llm.text import rows_of, texts_of

CAPACITY = 2048
PIECE = 512
GROUP = 1024  # pieces packed together

_PIECES = "number bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PLACED = "sequence_id bigint, offset bigint"


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document with n ids."""
    whole = n - n % capacity
    return ([(a, capacity) for a in range(0, whole, capacity)]
            + [(a, min(piece, n - a)) for a in range(whole, n, piece)])


def differenced(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fill of k windows, fullest first, and the windows of which pieces each one consists.

    Only windows that hold something are kept in a partition. A window made by a merge is a node
    with two parents, nodes below len(sizes) being the pieces themselves.
    """
    n = len(sizes)
    parts = {i: (sizes[i:i + 1].astype(np.int64), np.array([i])) for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parents: list[np.ndarray] = []
    nodes = name = n
    while len(heap) > 1:
        (fill_a, of_a), (fill_b, of_b) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        meet = max(0, len(fill_a) + len(fill_b) - k)
        alone = len(fill_a) - meet
        fill_b, of_b = fill_b[::-1], of_b[::-1]  # emptiest first
        parents.append(np.stack([of_a[alone:], of_b[:meet]], axis=1))
        fill = np.concatenate([fill_a[:alone], fill_a[alone:] + fill_b[:meet], fill_b[meet:]])
        made = np.arange(nodes, nodes + meet)
        of = np.concatenate([of_a[:alone], made, of_b[meet:]])
        nodes += meet
        order = np.argsort(-fill, kind="stable")
        parts[name] = fill[order], of[order]
        emptiest = int(fill[order[-1]]) if len(fill) == k else 0
        heapq.heappush(heap, (emptiest - int(fill[order[0]]), name))
        name += 1
    (fill, of), = parts.values()
    both = np.concatenate(parents) if parents else np.empty((0, 2), dtype=np.int64)
    window = np.empty(nodes, dtype=np.int64)
    window[of] = np.arange(len(of))
    for i in range(len(both) - 1, -1, -1):  # a node is younger than its parents
        window[both[i]] = window[n + i]
    ordered = np.argsort(window[:n], kind="stable")
    return fill, np.split(ordered, np.cumsum(np.bincount(window[:n], minlength=len(fill)))[:-1])


def fitting(sizes: np.ndarray, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Pieces of each window; as many windows as it takes for none to exceed the capacity."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        fill, windows = differenced(sizes, k)
        if fill[0] <= capacity:
            return windows
        k += 1


def _cut(tokenizer: str, end_id: int, capacity: int, piece: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(tokenizer, special=True)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_ids, texts in rows_of([batch]):
                rows = []
                for doc_id, text in zip(doc_ids, texts, strict=True):
                    ids = encoder.encode(text.decode("utf-8", "replace"))
                    ids.append(end_id)
                    coded = np.array(ids, dtype="<u4")
                    for a, length in cuts(len(ids), capacity, piece):
                        own = coded[a:a + length].tobytes()
                        rows.append((number, doc_id, a, length, zlib.crc32(own), len(ids),
                                     *([own] if with_ids else [])))
                        number += 1
                kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
                names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
    return run


def _placed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        windows = fitting(table["length"].to_numpy(), capacity)
        taken = table.take(pa.array(np.concatenate(windows)))
        length = taken["length"].to_numpy()
        sizes = [len(w) for w in windows]
        before = np.cumsum(length) - length
        first = np.cumsum(sizes) - sizes
        sequence = np.repeat(np.arange(len(windows)), sizes)
        group = table["group"][0].as_py()
        return (taken.drop_columns(["group", "number"])
                .append_column("sequence_id", pa.array(((group << 24) + sequence) * 2))
                .append_column("offset", pa.array(before - before[first][sequence])))
    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int, work: str, *, capacity: int = CAPACITY,
           piece: int = PIECE, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset.

    `ids` are little-endian 32-bit values; `work` is a fresh folder that all executors can reach.
    Pieces are written there once, so encoding is not repeated and a lost task finds them again.
    """
    spark = docs.sparkSession
    schema = _PIECES + (", ids binary" if with_ids else "")
    texts_of(docs).mapInArrow(_cut(tokenizer, end_id, capacity, piece, with_ids), schema).write.parquet(
        f"{work}/pieces")
    pieces = spark.read.parquet(f"{work}/pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    columns = [c.split()[0] for c in schema.split(", ")][1:]
    # Windows filled by one piece have odd numbers, the others even ones.
    alone = pieces.where(F.col("length") == capacity).select(
        *columns, (F.col("number") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    placed = (short.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
              .groupBy("group").applyInArrow(
                  _placed(capacity), schema.split(", ", 1)[1] + ", " + _PLACED))
    return placed.select(*columns, "sequence_id", "offset").unionByName(alone)


def windows(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_ids and ids (little-endian 32-bit values, padded to the capacity)."""
    pad = pad_id.to_bytes(4, "little").hex()
    joined = (pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")))
    digits = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return joined.select("sequence_id", "n_ids", F.unhex(
        F.rpad(digits, 8 * capacity, pad)).alias("ids"))
