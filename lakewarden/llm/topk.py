"""Exact top-k inner products: vectors in buckets of like length, pruned by local thresholds.

Candidates are ordered by length, longest first, and cut into buckets of BUCKET vectors. A query q
with a known k-th best score t needs from a bucket with longest vector l only vectors at a cosine
of at least t / (|q| l), its local threshold:

* above 1 nothing in this bucket or a later one can enter, so the query stops there;
* at COSINE or more, coordinate pruning: with cosine c to the query, the unit vector's coordinate
  f lies within q_f c -+ sqrt((1 - c^2)(1 - q_f^2)). The bucket keeps every coordinate sorted; the
  few largest coordinates of the query each give a run of that order, the shortest run is taken
  and checked against the others;
* below that, length pruning: the bucket is ordered by length, and only vectors of length
  t / |q| or more remain.

What remains is verified by the exact integer product. First thresholds come from the bucket of the
longest vectors; then every query goes to the buckets its threshold leaves, by bucket number, and
the best k per query and bucket are merged. The queries of a bucket meet it in blocks of about
QUERY_BLOCK, so the number of queries in one task does not grow with the table; a bucket is repeated
once per block, so buckets that nobody asks for do not move. How many buckets a
query needs is looked up by the binary logarithm of the length it asks for, in a table of at most
a few thousand steps.

Scores are exact while |q| |p| < 2**53 (products in double precision); beyond, 64-bit integers are
used, which holds while a score fits in a long.

Defined results: vectors that are null or hold null or non-finite components take no part; nor do
rows without an id, or vectors of another dimension than a query's. Ties go to the smaller id. A
query never meets rows with its own id. Rows that share an id are separate candidates with one
score each; a repeated query id is one query per distinct vector. Fewer candidates than k: all of
them. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1024
QUERY_BLOCK = 2048
STEPS = 16  # of the logarithm of a length, per doubling
COSINE = 0.6
FOCUS = 4
_SLACK = 1e-9

_PACKED = "part int, number bigint, dim int, ids binary, vectors binary, longest double"
_HITS = "query_id bigint, vec_id bigint, score bigint"


def quantized(column: str, scale: int) -> Column:
    """floor(scale * x) of every component; null if any is null or not finite."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, F.transform(
        x, lambda v: F.floor(v.cast("double") * scale).cast("bigint")))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of vectors of one dimension, longest first within a partition and block order."""

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        number = 0

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            rows_held = held.pop(key)
            data = np.array([r["v"] for r in rows_held], dtype=np.int64)
            ids = np.array([r["id"] for r in rows_held], dtype=np.int64)
            number += 1
            return pa.RecordBatch.from_pydict({
                "part": pa.array([key[0]], pa.int32()), "number": pa.array([number - 1], pa.int64()),
                "dim": pa.array([key[1]], pa.int32()), "ids": pa.array([ids.tobytes()]),
                "vectors": pa.array([data.tobytes()]),
                "longest": pa.array([float(rows_held[0]["len"])])})

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["part"], len(row["v"]))
                held.setdefault(key, []).append(row)
                if len(held[key]) == rows:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return vectors.withColumn("part", F.spark_partition_id()).mapInArrow(packs, _PACKED)


def _products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (vectors.astype(np.float64) @ queries.astype(np.float64)).astype(np.int64)
    return vectors @ queries


class Bucket:
    """A block of candidates, longest first, with each coordinate of its unit vectors sorted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self._unit: np.ndarray | None = None
        self._order: dict[int, np.ndarray] = {}

    def _coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if self._unit is None:
            self._unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        if f not in self._order:
            self._order[f] = np.argsort(self._unit[:, f], kind="stable")
        return self._order[f], self._unit[:, f]

    def candidates(self, query: np.ndarray, length: float, threshold: float | None) -> np.ndarray:
        """Positions that may reach the threshold (all, if there is none)."""
        if threshold is None or threshold <= 0 or not length or not self.longest:
            if threshold is not None and threshold > 0:
                return np.empty(0, dtype=np.int64)
            return np.arange(len(self.ids))
        local = threshold / (length * self.longest) - _SLACK
        if local > 1:
            return np.empty(0, dtype=np.int64)
        if local < COSINE:  # length pruning: lengths descend
            upto = np.searchsorted(-self.lengths, -(threshold / length) * (1 - _SLACK), "right")
            return np.arange(upto)
        unit = query / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        spread = np.sqrt(np.maximum(0.0, (1 - local**2) * (1 - unit[focus] ** 2)))
        low, high = unit[focus] * local - spread, unit[focus] * local + spread
        # A cosine above the local threshold widens towards the query itself.
        low = np.where(unit[focus] < -local, -1.0, low) - _SLACK
        high = np.where(unit[focus] > local, 1.0, high) + _SLACK
        best, at = None, 0
        for i, f in enumerate(focus):
            order, values = self._coordinate(int(f))
            column = values[order]
            a, b = np.searchsorted(column, low[i], "left"), np.searchsorted(column, high[i], "right")
            if best is None or b - a < len(best):
                best, at = order[a:b], i
        for i, f in enumerate(focus):
            if i != at and len(best):
                values = self._coordinate(int(f))[1][best]
                best = best[(values >= low[i]) & (values <= high[i])]
        return best

    def top(self, query_id: int, query: np.ndarray, k: int, threshold: float | None
            ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k that reach the threshold."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        at = self.candidates(query, length, threshold)
        at = at[self.ids[at] != query_id]
        if not len(at):
            return self.ids[:0], self.ids[:0]
        scores = _products(query, self.vectors[at], length * self.longest < 2**52)
        ids = self.ids[at]
        if threshold is not None:
            enough = scores >= threshold
            ids, scores = ids[enough], scores[enough]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _searched(k: int):
    def search(buckets: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.empty(0, dtype=np.int64),) * 3]
        for row in buckets.select(["ids", "vectors"]).to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            bucket = Bucket(ids, np.frombuffer(row["vectors"], dtype=np.int64).reshape(len(ids), -1))
            for q in queries.select(["id", "v", "known"]).to_pylist():
                best, scores = bucket.top(q["id"], np.array(q["v"], dtype=np.int64), k, q["known"])
                found.append((np.full(len(best), q["id"], dtype=np.int64), best, scores))
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])
    return search


def _level(x: Column) -> Column:
    return F.floor(F.log2(x) * STEPS).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int, work: str, *, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = 256, bucket: int = BUCKET,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; `work` is a fresh folder that all executors can reach."""
    spark = vectors.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    usable = written(
        vectors.select(F.col(id_column).cast("bigint").alias("id"), is_query.alias("asks"),
                       quantized(vector_column, scale).alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL").withColumn("len", F.sqrt(squares)), "vectors")

    # Ranges of lengths, longest first; buckets are numbered through in that order.
    ordered = usable.repartitionByRange(F.desc("len"), F.desc("id")).sortWithinPartitions(
        F.desc("len"), "id")
    packed = written(_packed(ordered.select("id", "v", "len"), bucket), "packed")
    by_length = Window.partitionBy("dim").orderBy(F.desc("longest"), "part", "number")
    # The directory has one small row per BUCKET vectors.
    directory = packed.select("part", "number", "dim", "longest").withColumn(
        "bucket", F.row_number().over(by_length))
    buckets = packed.join(directory.select("part", "number", "bucket"), ["part", "number"])

    asked = (usable.where("asks").select("id", "v", "len").distinct()
             .withColumn("dim", F.size("v")))

    def meet(some: DataFrame, queries: DataFrame, name: str) -> DataFrame:
        keys = ["dim", "bucket", "salt"]
        # One row per bucket that is asked for.
        blocks = written(queries.groupBy("dim", "bucket").agg(
            F.ceil(F.count("*") / query_block).cast("int").alias("blocks")), name)
        dealt = queries.join(blocks, ["dim", "bucket"]).withColumn(
            "salt", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        again = spark.read.parquet(f"{work}/{name}")
        spread = some.join(again, ["dim", "bucket"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
            _searched(k), _HITS)

    # The bucket of the longest vectors sets the first thresholds.
    unknown = F.lit(None).cast("bigint")
    first = written(meet(buckets.where("bucket = 1"), asked.withColumn("known", unknown)
                         .withColumn("bucket", F.lit(1)), "first-blocks"), "first")
    known = first.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), asc=False)[k - 1])
        .alias("known"))

    # How many buckets hold vectors of a length level or more, for every level there is.
    levels = directory.groupBy("dim", F.coalesce(_level("longest"), F.lit(-1)).alias("level")).agg(
        F.count("*").alias("n"))
    dense = levels.groupBy("dim").agg(F.min("level").alias("a"), F.max("level").alias("b")).select(
        "dim", F.explode(F.sequence("a", F.col("b") + 1)).alias("level"))
    upward = Window.partitionBy("dim").orderBy(F.desc("level"))
    needed = dense.join(levels, ["dim", "level"], "left").select(
        "dim", "level", F.coalesce(F.sum("n").over(upward), F.lit(0)).cast("int").alias("last"))
    bounds = levels.groupBy("dim").agg(F.min("level").alias("a"), F.max("level").alias("b"))
    # One level lower than asked for covers what rounding may do to a logarithm.
    wanted = F.when((F.col("known") > 0) & (F.col("len") > 0),
                    _level(F.col("known") / F.col("len")) - 1)
    wanted = F.least(F.greatest(F.coalesce(wanted, F.col("a")), F.col("a")), F.col("b") + 1)
    rest = (asked.join(known, asked["id"] == known["query_id"], "left").drop("query_id")
            .join(bounds, "dim").withColumn("level", wanted).drop("a", "b")
            .join(needed, ["dim", "level"]).where("last > 1")
            .withColumn("bucket", F.explode(F.sequence(F.lit(2), F.col("last"))))
            .drop("last", "level", "len"))
    hits = first.unionByName(meet(buckets.where("bucket > 1"), rest, "blocks"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
