import math
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.llm.topk import top_k


def brute(rows, asks, k, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in ok if asks(i)}):
        found = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i)
                       for i, v in ok if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_equals_brute_force(spark, work, spread):
    chosen = random.Random(9)
    rows = []
    for i in range(400):
        length = math.exp(chosen.gauss(0, spread))
        rows.append((i, [length * chosen.gauss(0, 1) for _ in range(6)]))
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None] * 3), (503, [float("nan")] * 6),
             (504, [float("inf")] * 6), (505, [0.0] * 6), (510, [-1.0] * 6), (None, [1.0] * 6),
             (520, [0.0] * 6), (530, [1.0, 2.0]), (531, [3.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                               "vec_id bigint, embedding array<double>, len int, salt string")
    got = top_k(df, F.col("vec_id") % 10 == 0, 5, work, bucket=32, query_block=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5)


def test_no_rows(spark, work):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 2 == 0, 3, work).collect() == []


def test_buckets_are_repeated_for_their_own_queries_only(spark, work):
    """A few long vectors set thresholds that leave most buckets unasked for."""
    chosen = random.Random(3)
    rows = [(i, [(chosen.random() + 0.5) * (50 if i < 40 else 1) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = top_k(df, F.col("vec_id") % 10 == 0, 5, work, bucket=8, query_block=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5)
    first = spark.read.parquet(f"{work}/first-blocks").collect()
    assert [(r["bucket"], r["blocks"]) for r in first] == [(1, 9)]  # 60 queries in blocks of 7
    rest = {r["bucket"]: r["blocks"] for r in spark.read.parquet(f"{work}/blocks").collect()}
    assert sorted(rest) == list(range(2, max(rest) + 1)) and max(rest) < 10  # of 75 buckets
    assert [rest[b] for b in sorted(rest)] == sorted(rest.values(), reverse=True)
