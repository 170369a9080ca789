import numpy as np

from lakewarden.llm import text as T


def test_words_are_cut_at_ascii_blanks_only(odd_texts):
    texts = [(t or "").encode() for t in odd_texts]
    hashes, counts = T.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    seen = {}
    for word, value in zip(words, zip(*hashes.tolist()), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len({v[0] for v in seen.values()}) == len(seen)


def thue_morse(size):
    """Two words of letters in which sums of powers of any odd base are the same modulo 2**64."""
    first = bytes(97 + bin(i).count("1") % 2 for i in range(size))
    return first, first.translate(bytes.maketrans(b"ab", b"ba"))


def test_words_and_windows_that_powers_of_a_base_do_not_tell_apart():
    for size in (32, 64, 1024, 4096):
        first, second = thue_morse(size)
        hashes, _ = T.word_hashes([first + b" " + second])
        assert (hashes[:, 0] != hashes[:, 1]).all()
        words, _ = T.word_hashes([b" ".join(bytes([c]) for c in first), b" ".join(bytes([c]) for c in second)])
        for which in range(2):
            windows = T.rolling(words[which], size, which)
            assert windows[0] != windows[-1]


def test_pairs_are_told_apart_by_both_halves():
    first = np.array([5, 1, 5, 5, 1], dtype=np.uint64)
    second = np.array([2, 7, 1, 2, 7], dtype=np.uint64)
    a, b, at, back = T.distinct_pairs(first, second)
    assert (a.tolist(), b.tolist(), at.tolist()) == ([1, 5, 5], [7, 1, 2], [1, 2, 0])
    assert back.tolist() == [2, 0, 1, 2, 0]


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = b" ".join(b"w%d" % (i % 97) for i in range(5000))
    whole, _ = T.word_hashes([text, b"tail"])
    monkeypatch.setattr(T, "SEGMENT", 64)
    parts, counts = T.word_hashes([text, b"tail"])
    assert (whole == parts).all() and counts.tolist() == [5000, 1]


def test_windows():
    counts = np.array([3, 0, 2, 5])
    starts, owner = T.window_starts(counts, 3)
    assert starts.tolist() == [0, 5, 6, 7] and owner.tolist() == [0, 3, 3, 3]
    assert T.covered(np.array([1, 6]), 3, 10).tolist() == [
        False, True, True, True, False, False, True, True, True, False]
    words = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 3, 5, 7, 50, 400, 401):
        found = T.rolling(words, width)
        assert len(found) == max(0, 401 - width)
        groups = {}
        for i, value in enumerate(found.tolist()):
            groups.setdefault(tuple(words[i:i + width].tolist()), set()).add(value)
        assert all(len(v) == 1 for v in groups.values())
        assert len({next(iter(v)) for v in groups.values()}) == len(groups)
