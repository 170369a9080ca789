import random

import pytest

from lakewarden.llm.mixing import fit_counts, mix, mixed_sizes, water_level


def test_targets_by_hand():
    # 100 words: shares 62.5, 25, 12.5; the first stops at 30, and so on.
    assert water_level([10, 60, 30], [5, 2, 1], 3) == pytest.approx([30, 140 / 3, 70 / 3])
    assert water_level([100, 0], [5, 2], 3) == [100, 0]
    assert water_level([], [], 3) == []
    shares = water_level([1, 1, 98], [5, 2, 1], 3)
    assert shares == pytest.approx([3, 3, 94])


def test_counts_come_near_the_budget():
    chosen = random.Random(6)
    for _ in range(60):
        lengths = sorted(chosen.sample(range(1, 3000), chosen.randrange(1, 60)))
        counts = [chosen.randrange(1, 40) for _ in lengths]
        whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = chosen.randrange(whole + 1)
        taken = fit_counts(lengths, counts, budget, exact=5000)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(a * t for a, t in zip(lengths, taken, strict=True))
        assert abs(got - budget) <= lengths[-1] / 2
    assert fit_counts([0, 3, 5], [9, 2, 1], 8) == [0, 1, 1]
    assert fit_counts([7], [3], 8) == [1]
    assert fit_counts([], [], 5) == []


def test_no_choice_of_documents_comes_nearer():
    assert fit_counts([10, 7], [1, 1], 9) == [1, 0]
    assert fit_counts([4, 6], [2, 2], 12) == [0, 2]
    assert fit_counts([10], [3], 15) == [1]  # as near as two: the smaller sum
    chosen = random.Random(8)
    for _ in range(400):
        lengths = sorted(chosen.sample(range(0, 60), chosen.randrange(1, 6)))
        counts = [chosen.randrange(1, 7) for _ in lengths]
        sums = {0}
        for a, c in zip(lengths, counts, strict=True):
            sums = {s + a * k for s in sums for k in range(c + 1)}
        budget = chosen.randrange(max(sums) + 1)
        taken = fit_counts(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(a * t for a, t in zip(lengths, taken, strict=True))
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_long_lists_of_lengths_without_a_hit():
    # Even lengths only: an odd budget is missed by one, after all steps were tried.
    lengths = list(range(2, 4002, 2))
    taken = fit_counts(lengths, [300] * len(lengths), 90_001)
    assert sum(a * t for a, t in zip(lengths, taken, strict=True)) == 90_000


def documents(count=600):
    chosen = random.Random(1)
    rows = []
    for i in range(count):
        source = "big" if i % 3 == 0 else chosen.choice(["a", "Z", "é", None, "tiny"])
        n = 40 if source == "big" else chosen.randrange(60)
        rows.append((i, " ".join(["w"] * n) if n else chosen.choice([None, "", " \n"]), source))
    return rows


def test_sources_come_near_their_targets(make_docs):
    rows = documents() + [(3, "w w w", "a"), (3, "w w w", "a")]
    found = [r.asDict() for r in mixed_sizes(make_docs(rows)).collect()]
    assert len(found) == len(rows)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in sources]
    shares = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    for source, size, share in zip(sources, sizes, shares, strict=True):
        own = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert [r["target"] for r in own] == pytest.approx([share] * len(own))
        assert abs(sum(r["size"] * r["repeats"] for r in own) - share) <= 20
        assert all(0 <= r["repeats"] <= 3 for r in own)
        spread = {r["repeats"] for r in own if r["size"]}
        assert max(spread) - min(spread) <= 1


def test_reruns_agree_however_the_rows_lie(make_docs):
    rows = documents(200)
    first = mix(make_docs(rows)).drop("batch").collect()
    again = mix(make_docs(rows[::-1]).repartition(7)).drop("batch").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert "kept_0" in first[0].asDict()


def test_no_documents(make_docs):
    assert mix(make_docs([])).collect() == []
    empty = mixed_sizes(make_docs([(1, None, None), (2, "", "a")])).collect()
    assert {(r["size"], r["repeats"], r["target"]) for r in empty} == {(0, 0, 0.0)}
