"""Removing word passages that also stand in a document with a smaller id, with exact results.

A window is WINDOW consecutive words. A word is removed if a window that covers it starts, word for
word, in a document with a smaller doc_id as well. Three passes over batches of documents:

1. every batch sends count-min sketches of its windows to the shards of the hash range, which merge
   them and answer which windows may be repeated (see sketch.py). Estimates are never too low;
2. only windows estimated repeated are sent on, as 128-bit hashes with the smallest id they have in
   the batch; a shard groups equal hashes and answers which of them have a smaller id elsewhere;
3. every batch removes the covered words.

Windows are told apart by 128 bits throughout. Documents go to batches by a hash of id and text. All passes read the same shuffled batches (one
exchange, reused), and only hashes and bits travel between batches and shards. A window that a
third of all documents hold is one entry per batch, so no task sees its occurrences one by one.

Defined results: a null text has no words. Documents with fewer words than a window lose nothing.
Rows with the same doc_id take nothing from each other. Rows without doc_id neither lose words nor
take any from others. Equal windows within one document are left alone. Extra columns are passed
through if named in `keep`. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.sketch import Sketch, bits, flags
from lakewarden.llm.text import (
    covered,
    distinct_pairs,
    rolling,
    texts_of,
    window_starts,
    word_hashes,
)

WINDOW = 50
BATCH_BYTES = 4 << 20
BYTES_PER_WORD = 6  # for the layout only: fewer bytes a word fill the sketch more

_ANSWERS = "batch int, kind int, shard int, answers array<binary>"


def batches(docs: DataFrame, keep: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES
            ) -> tuple[DataFrame, int, int]:
    """Documents with their batch, the bytes of all texts, and the number of batches.

    Kept columns become kept_0, kept_1, ...
    """
    given = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    texts = texts_of(docs, *given)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    number = max(-(-size // batch_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    return texts.withColumn("batch", batch_of(spread(), number)), size, number


def spread() -> Column:
    """What the batch of a row follows from: rows that share a doc_id are dealt by their texts."""
    return F.xxhash64("doc_id", "text")


def batch_of(value: Column, number: int) -> Column:
    return F.pmod(value, F.lit(number)).cast("int")


class Windows:
    """The distinct windows of a batch, by ascending hash."""

    def __init__(self, table: pa.Table, width: int):
        self.batch = table["batch"][0].as_py()
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        # Rows without an id come first; they have no windows.
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0,
                                                            texts[i]))
        self.texts = [texts[i] for i in self.order]
        known = np.array([ids[i] is not None for i in self.order])
        self.ids = np.array([ids[i] or 0 for i in self.order], dtype=np.int64)
        self.words, self.counts = word_hashes(self.texts)
        self.width = width
        self.starts, document = window_starts(self.counts, width)
        if not known.all():
            with_id = known[document]
            self.starts, document = self.starts[with_id], document[with_id]
        hashes = [rolling(self.words[i], width, i)[self.starts] if len(self.starts) else
                  np.empty(0, dtype=np.uint64) for i in range(2)]
        self.keys, self.others, self.first, self.back = distinct_pairs(*hashes)
        self.owner = self.ids[document]
        self.smallest = self.owner[self.first]  # ids ascend, so the first one is the smallest
        largest = self.smallest.copy()
        np.maximum.at(largest, self.back, self.owner)
        self.shared = largest > self.smallest

    def removed(self, smaller_elsewhere: np.ndarray) -> np.ndarray:
        """Which words of the batch go, given which keys have a smaller id in another batch."""
        hit = smaller_elsewhere[self.back] | (self.owner > self.smallest[self.back])
        return covered(self.starts[hit], self.width, self.words.shape[1])


def _answers(answers: pa.Table, kind: int) -> dict[int, list[bytes]]:
    return {r["shard"]: r["answers"] for r in answers.to_pylist() if r["kind"] == kind}


def _sketched(sketch: Sketch, width: int):
    def run(table: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        parts = sketch.partial(windows.keys, windows.shared)
        return pa.table({"shard": pa.array([s for s, _ in parts], pa.int32()),
                         "batch": pa.array([windows.batch] * len(parts), pa.int32()),
                         "blobs": pa.array([b for _, b in parts], pa.list_(pa.binary()))})
    return run


def merged(sketch: Sketch):
    """Shard side of the first pass; rows (shard, batch, blobs)."""
    def run(table: pa.Table) -> pa.Table:
        answers = sketch.merged(table["blobs"].to_pylist())
        return pa.table({"batch": table["batch"],
                         "kind": pa.array([0] * len(table), pa.int32()),
                         "shard": table["shard"],
                         "answers": pa.array(answers, pa.list_(pa.binary()))})
    return run


def _estimated(sketch: Sketch, width: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if len(table):
            windows = Windows(table, width)
            which = np.flatnonzero(sketch.repeated(windows.keys, _answers(answers, 0)))
            keys, ids = windows.keys[which], windows.smallest[which]
            others = windows.others[which]
            for shard, a, b in sketch.parts(keys):
                for column, value in zip(columns, (
                        shard, windows.batch, keys[a:b].tobytes(), others[a:b].tobytes(),
                        ids[a:b].tobytes()), strict=True):
                    column.append(value)
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        names=["shard", "batch", "keys", "others", "ids"])
    return run


def _grouped(table: pa.Table) -> pa.Table:
    """Shard side of the second pass: which windows of a batch have a smaller id elsewhere."""
    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)

    keys, others, ids = joined("keys", np.uint64), joined("others", np.uint64), joined("ids", np.int64)
    order = np.lexsort((ids, others, keys))
    k, o, i = keys[order], others[order], ids[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.empty(len(k), dtype=bool)
    smaller[order] = least < i
    ends = np.cumsum([len(b) // 8 for b in table["ids"].to_pylist()])
    parts = np.split(smaller, ends[:-1])
    return pa.table({"batch": table["batch"], "kind": pa.array([1] * len(table), pa.int32()),
                     "shard": table["shard"],
                     "answers": pa.array([[bits(p)] for p in parts], pa.list_(pa.binary()))})


def _cleaned(sketch: Sketch, width: int, kept_names: list[str], as_is: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            table = table.slice(0, 0)
            removed_per_text = words_per_text = np.empty(0, dtype=np.int64)
            texts, order = [], []
        else:
            windows = Windows(table, width)
            which = np.flatnonzero(sketch.repeated(windows.keys, _answers(answers, 0)))
            found = _answers(answers, 1)
            elsewhere = np.zeros(len(windows.keys), dtype=bool)
            for shard, a, b in sketch.parts(windows.keys[which]):
                elsewhere[which[a:b]] = flags(found[shard][0], b - a)
            gone = windows.removed(elsewhere)
            ends = np.cumsum(windows.counts)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed_per_text = sums[ends] - sums[ends - windows.counts]
            words_per_text, order = windows.counts, windows.order
            texts = []
            for text, end, n, r in zip(windows.texts, ends, windows.counts, removed_per_text,
                                       strict=True):
                if as_is and not r:
                    texts.append(text)
                    continue
                words = text.split()
                texts.append(b" ".join(compress(words, ~gone[end - n:end]) if r else words))
        table = table.take(pa.array(order, pa.int64()))
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(words_per_text, pa.int64()),
            "n_removed": pa.array(removed_per_text, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()), **{c: table[c] for c in kept_names}})
    return run


def without_repeats(docs: DataFrame, *, width: int = WINDOW, keep: tuple[str, ...] = (),
                    as_is: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank), columns of `keep`.

    With `as_is` a text that loses nothing stays as it was, blanks included.
    """
    given, size, _ = batches(docs, keep, batch_bytes)
    sketch = Sketch.for_keys(size // BYTES_PER_WORD)
    grouped = given.groupBy("batch")
    sketches = grouped.applyInArrow(_sketched(sketch, width),
                                    "shard int, batch int, blobs array<binary>")
    first = sketches.groupBy("shard").applyInArrow(merged(sketch), _ANSWERS)
    estimated = grouped.cogroup(first.groupBy("batch")).applyInArrow(
        _estimated(sketch, width), "shard int, batch int, keys binary, others binary, ids binary")
    second = estimated.groupBy("shard").applyInArrow(_grouped, _ANSWERS)
    names = [f"kept_{i}" for i in range(len(keep))]
    schema = ["doc_id bigint", "n_words bigint", "n_removed bigint", "kept_text binary",
              *[f"{n} {docs.schema[c].dataType.simpleString()}"
                for n, c in zip(names, keep, strict=True)]]
    out = grouped.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(
        _cleaned(sketch, width, names, as_is), ", ".join(schema))
    return out.select("doc_id", "n_words", "n_removed",
                      F.col("kept_text").cast("string").alias("kept_text"),
                      *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])
