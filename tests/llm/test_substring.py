import random

from lakewarden.llm.sketch import Sketch, opened_cells, packed_cells
from lakewarden.llm.substring import without_repeats


def brute(rows, width):
    first = {}
    words_of = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in words_of:
        for p in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[p:p + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in words_of:
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            if i is not None and first[tuple(words[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((i, len(words), sum(gone), kept))
    return sorted(out, key=repr)


def test_equals_brute_force(make_docs, odd_texts):
    chosen = random.Random(2)
    passages = [" ".join(chosen.choice("abcdef") + str(chosen.randrange(9)) for _ in range(9))
                for _ in range(6)]
    rows = [(chosen.randrange(10_000), " ".join(
        chosen.choice([*passages, f"z{chosen.randrange(10**6)}", "the same\twords"])
        for _ in range(chosen.randrange(12)))) for _ in range(150)]
    rows += [(20_000 + i, t) for i, t in enumerate(odd_texts)]
    rows += [(5, passages[0]), (5, passages[0]), (None, passages[0]), (None, passages[1])]
    got = without_repeats(make_docs(rows), width=7, batch_bytes=2000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 7)


def test_unchanged_texts_can_stay_as_they_were(make_docs):
    rows = [(1, "a  b\nc d"), (2, "x  a  b c d  y")]
    got = without_repeats(make_docs(rows), width=4, as_is=True, keep=("kept_0", "batch")).collect()
    assert sorted(map(tuple, got)) == [(1, 4, 0, "a  b\nc d", "x", 1), (2, 6, 4, "x y", "x", 1)]


def test_long_words_that_differ_in_few_letters(make_docs):
    from test_text import thue_morse
    for size in (1024, 4096):
        first, second = (w.decode() for w in thue_morse(size))
        around = [f"w{i}" for i in range(60)]
        rows = [(i, " ".join([*around[:30], word, *around[30:]])) for i, word in ((1, first), (2, second))]
        got = without_repeats(make_docs(rows)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 50)
        assert all(r["n_removed"] == 0 for r in got)


def test_many_rows_of_one_id(make_docs):
    rows = [(3, f"a{i} b c d e f g h") for i in range(200)] + [(1, "b c d e f g h"), (4, "x b c d e f g h")]
    got = without_repeats(make_docs(rows), width=7, batch_bytes=500).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 7)


def test_no_documents(make_docs):
    assert without_repeats(make_docs([])).collect() == []


def test_sketch_never_loses_a_repeated_key():
    import numpy as np
    random_ = np.random.default_rng(3)
    pool = random_.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for depth in (1, 2):
        sketch = Sketch.for_keys(4000, cell_bits=10, depth=depth)
        batches = [np.unique(random_.choice(pool, 600)) for _ in range(5)]
        many = [random_.random(len(b)) < 0.01 for b in batches]
        shards = {}
        for n, (keys, flag) in enumerate(zip(batches, many, strict=True)):
            for shard, blobs in sketch.partial(keys, flag):
                shards.setdefault(shard, []).append((n, blobs))
        answers = [{} for _ in batches]
        for shard, parts in shards.items():
            for (n, _), answer in zip(parts, sketch.merged([b for _, b in parts]), strict=True):
                answers[n][shard] = answer
        keys, counts = np.unique(np.concatenate(batches), return_counts=True)
        repeated = set(keys[counts > 1].tolist())
        for keys, flag, answer in zip(batches, many, answers, strict=True):
            said = set(keys[sketch.repeated(keys, answer)].tolist())
            assert said >= (repeated & set(keys.tolist())) | set(keys[flag].tolist())
            assert len(said) < len(keys)


def test_cells_with_large_gaps():
    import numpy as np
    for cells in ([], [0], [5, 6, 70_000, 70_001, 2**32 - 1]):
        assert opened_cells(packed_cells(np.array(cells, dtype=np.int64))).tolist() == cells
