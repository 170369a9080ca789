import itertools

import pytest
from test_matching import confidence

from lakewarden.operators import match_pairs as mp
from lakewarden.operators import ranked_pairs as rp
from lakewarden.operators.keyed import Skew

NAMES = ["OLD STORE", "OLD STORES", "NEW STORE", "PARK", "", None, "HILL 12", "OLD STORE"]


def members(spark, records):
    df = spark.createDataFrame(records, "id int, name string, block string")
    return mp.members(mp.prepare(df, "id", "name", "block"), "id")


def records_of(seed=0, count=60):
    # Three blocks, one with most rows; ids 7 and 9 are there more than once.
    found = [(i, NAMES[(i * 5 + seed) % len(NAMES)], "AAAAAB C"[i % 8].strip() or None)
             for i in range(count)]
    return found + [(7, "PARK", "A"), (7, "PARK", "A"), (9, "OLD STORE", "A"), (None, "X", "A")]


def all_pairs(records):
    found = []
    for (i, n, b), (j, m, c) in itertools.combinations(records, 2):
        if b is not None and b == c and i is not None and j is not None and i != j:
            (i, n), (j, m) = sorted(((i, n), (j, m)), key=lambda t: t[0])
            score = None if n is None or m is None else confidence(n, m)
            found.append((i, j, n, m, b, score))
    return found


@pytest.mark.parametrize("skew", [Skew(), Skew(5)])
def test_slices_are_all_pairs_once(spark, skew):
    records = records_of()
    ranked = rp.numbered(members(spark, records)).cache()
    blocks = rp.blocks_of(ranked).cache()
    total = sum(r["ranks"] for r in blocks.collect())
    got = []
    for first in range(0, int(total), 400):
        part = rp.pair_slice(ranked, blocks, first, 400, skew=skew).collect()
        assert len(part) <= 400
        got += [(r["id_a"], r["id_b"], r["name_a"], r["name_b"], r["block"], r["match_confidence"])
                for r in part]
    assert sorted(got, key=repr) == sorted(all_pairs(records), key=repr)
    assert rp.pair_slice(ranked, blocks, int(total), 10).count() == 0
    few = rp.pair_slice(ranked, blocks, 0, 3)
    assert few.count() == 3 and rp.rejects(few).columns[0] == "id_a"


def test_a_rank_far_beyond_exact_roots(spark):
    ranks = [0, 1, 2, 3, 10**15, 2 * 10**9 * (2 * 10**9 - 1) // 2 - 1, 2 * 10**9 * (2 * 10**9 - 1) // 2]
    expected = set()
    for rank in ranks:
        j = int((1 + (1 + 8 * rank) ** 0.5) / 2)
        j = next(k for k in range(max(1, j - 3), j + 4) if k * (k - 1) // 2 <= rank < k * (k + 1) // 2)
        expected |= {(rank, j, rank - j * (j - 1) // 2)}
    positions = sorted({p for _, j, i in expected for p in (i, j)})
    records = spark.createDataFrame([("A", f"N {p}", p, p) for p in positions],
                                    "block string, name string, id long, position long")
    found = rp.pairs_at(records, spark.createDataFrame([("A", r) for r in ranks],
                                                       "block string, rank long"))
    assert {(r["rank"], r["id_b"], r["id_a"]) for r in found.collect()} == expected


def test_mean_is_exact_in_small_blocks(spark):
    records = records_of()
    scores = [p[-1] for p in all_pairs(records) if p[-1] is not None]
    row = rp.mean_confidence(members(spark, records)).first()
    assert row["total_pairs"] == len(scores) and row["sampled_blocks"] == 0
    assert row["avg_confidence"] == pytest.approx(sum(scores) / len(scores))
    assert row["low"] == row["high"] == row["avg_confidence"]


def test_interval_of_a_sample_covers_the_mean(spark):
    records = records_of(count=160)
    scores = [p[-1] for p in all_pairs(records) if p[-1] is not None]
    truth = sum(scores) / len(scores)
    rows = [rp.mean_confidence(members(spark, records), exact_pairs=200, draws=400, seed=s).first()
            for s in range(3)]
    assert all(r["low"] <= truth <= r["high"] and r["high"] - r["low"] < 0.2 for r in rows)
    assert all(r["sampled_blocks"] == 1 and r["total_pairs"] == len(scores) for r in rows)
    assert len({r["avg_confidence"] for r in rows}) == 3


def test_nothing_to_pair(spark):
    row = rp.mean_confidence(members(spark, [(1, "A", "B"), (2, None, "B"), (3, "C", None)])).first()
    assert row["total_pairs"] == 0 and row["avg_confidence"] is None
    ranked = rp.numbered(members(spark, []))
    assert rp.pair_slice(ranked, rp.blocks_of(ranked), 0, 5).count() == 0
