import random
from itertools import combinations

import numpy as np

from lakewarden.llm import part_enum
from lakewarden.llm.jaccard_join import components, near_duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least[root(i)] if d is not None else None)
                   for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def changed(words, times, chosen):
    words = list(words)
    for _ in range(times):
        at = chosen.randrange(len(words))
        words[at:at + chosen.randrange(2)] = [f"n{chosen.randrange(10**6)}"][:chosen.randrange(2)]
        words = words or ["x"]
    return " ".join(words)


def test_equals_brute_force(make_docs, odd_texts, work):
    chosen = random.Random(8)
    rows = []
    for size in (1, 3, 5, 8, 9, 12, 20, 40, 90, 300, 600):
        for _ in range(4):
            words = [f"w{chosen.randrange(400)}" for _ in range(size)]
            for _ in range(6):
                rows.append((chosen.randrange(10**6), changed(
                    words, chosen.randrange(1 + size // 25 + 1), chosen)))
    group = [f"g{i}" for i in range(120)]  # a large group of near copies
    rows += [(chosen.randrange(10**6), changed(group, chosen.randrange(4), chosen))
             for _ in range(80)]
    rows += [(2_000_000 + i, t) for i, t in enumerate(odd_texts)]
    rows += [(7, "Same WORDS in these two rows"), (7, "same words in these two rows"), (7, "other"),
             (None, "same words in these two rows"), (None, None)]
    got = near_duplicates(make_docs(rows), work, batch_bytes=20_000, cell_bits=14).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_several_texts_of_one_id(make_docs, work):
    rows = []
    for doc_id in (5, 6, 11, 12, 500):
        for k in range(4):
            text = " ".join(f"d{doc_id}k{k}w{i}" for i in range(80))
            rows += [(doc_id, text), (1000 * (k + 1) + doc_id, text + " more")]
    rows += [(700, "short text"), (700, "SHORT  text"), (600, "short text"), (500, "short text")]
    got = near_duplicates(make_docs(rows), work).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_words_that_powers_of_a_base_do_not_tell_apart(make_docs, work):
    from test_text import thue_morse
    first, second = (w.decode() for w in thue_morse(1024))
    rows = [(1, "x y " + first), (2, "x y " + second), (3, first), (4, second)]
    got = near_duplicates(make_docs(rows), work).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_signatures_of_many_are_cut_into_blocks(make_docs, work, monkeypatch):
    from lakewarden.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    chosen = random.Random(9)
    rows = []
    for group in range(6):  # groups of near copies that share half of their words with each other
        common = [f"c{i}" for i in range(30)]
        words = common + [f"g{group}w{i}" for i in range(30)]
        rows += [(chosen.randrange(10**6), changed(words, chosen.randrange(4), chosen)) for _ in range(25)]
    got = near_duplicates(make_docs(rows), work, batch_bytes=20_000, cell_bits=14).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_block_pairs_hold_every_two_members_once():
    from lakewarden.llm.jaccard_join import _block_pairs
    keys = np.array([9] * 40 + [8] * 3, dtype=np.uint64)
    cids, blocks = np.arange(43), np.array([5] * 40 + [1] * 3)
    at, key, side = _block_pairs(keys, cids, blocks)
    met = []
    for k in np.unique(key):
        here = [(int(a), int(s)) for a, s in zip(at[key == k], side[key == k], strict=True)]
        met += [(min(a, b), max(a, b)) for (a, s), (b, t) in combinations(here, 2) if s == t == 0 or {s, t} == {1, 2}]
    assert sorted(met) == sorted([*combinations(range(40), 2), *combinations(range(40, 43), 2)])


def test_no_documents(make_docs, work):
    assert near_duplicates(make_docs([]), work).collect() == []


def test_similar_sets_share_enough_signatures():
    random_ = np.random.default_rng(5)
    for _ in range(150):
        n = int(random_.choice([4, 5, 8, 13, 20, 30, 60, 100, 250, 700]))
        a = np.unique(random_.integers(0, 2**63, n, dtype=np.uint64))
        most = int(2 * n * 0.2 / 1.8) + 1
        b = np.unique(np.concatenate([
            random_.permutation(a)[random_.integers(0, most + 1):],
            random_.integers(0, 2**63, random_.integers(0, most + 1), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not part_enum.reaches(common, len(a), len(b), 80) or common == len(a) == len(b):
            continue
        hashes, owner, check, group, check_owner, need = part_enum.all_signatures([a, b], 80)
        both = np.intersect1d(hashes[owner == 0], hashes[owner == 1])
        shared = np.isin(hashes, both)
        for side in (0, 1):
            groups = [len(set(group[(check == c) & shared].tolist()))
                      for c in np.flatnonzero(check_owner == side)]
            needs = need[check_owner == side]
            assert any(g >= m and g for g, m in zip(groups, needs, strict=True))
        maps = part_enum.parities([a, b])
        assert part_enum.may_reach(maps[0], len(a), maps[1], len(b), 80)


def test_components_of_a_long_chain(spark, work):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 499), (7, 7)]
    written = []

    def write(df, name):
        written.append(f"{work}/{name}-{len(written)}")
        df.write.parquet(written[-1])
        return spark.read.parquet(written[-1])

    found = components(spark.createDataFrame(links, "a bigint, b bigint"), write).collect()
    assert {r["cid"]: r["label"] for r in found} == {
        **{i: 0 for i in range(201)}, 499: 499, 500: 499, 501: 499}
