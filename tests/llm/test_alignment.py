"""Alignment against a version that compares every two tokens' byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakewarden.llm import alignment
from lakewarden.llm.byte_bpe import byte_letters
from lakewarden.llm.perfect_hash import PerfectHash
from lakewarden.llm.queries import BYTE_BPE, PIECES, tokenizer_path


def _tokens(text):
    """(id, bytes) of both tokenizers, straight from the two libraries."""
    first = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    letters = byte_letters()

    def tokens(text):
        a = [(i, bytes(letters[c] for c in first.id_to_token(i)))
             for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i)
                      else piece.replace("▁", " ").encode()))
        return a, b
    return tokens(text) if text is not None else tokens


def brute_force(rows):
    tokens = _tokens(None)
    links, counts, found = [], Counter(), []
    for _, text in rows:
        a, b = tokens(text) if text else ([], [])
        given = b" " + (text or "").encode()
        if b"".join(t for _, t in a) != given or b"".join(t for _, t in b) != given:
            a, b = [], []
        own, groups = [], []
        at = i = j = at_b = 0
        group = ([], [])
        while i < len(a) or j < len(b):  # the side that ends first goes on
            if at <= at_b and i < len(a):
                group[0].append(a[i][0])
                begin, at = at, at + len(a[i][1])
                low = 0
                for x, t in b:
                    if low < at and begin < low + len(t):
                        own.append((a[i][0], x))
                    low += len(t)
                i += 1
            else:
                group[1].append(b[j][0])
                at_b += len(b[j][1])
                j += 1
            if at == at_b and group[0] and group[1]:
                groups.append(group)
                group = ([], [])
        links.append(own)
        counts.update(set(own))
        found.append((len(a), len(b), groups))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups), own in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(own),
                    sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), text))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _found(docs, work, **settings):
    df = alignment.aligned(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECES), work, **settings)
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def _texts():
    chosen = random.Random(5)
    letters = list("ab XY.,'  \n\té日🙂²½") + ["the ", " and", "ing", "naïve", "▁", "<s>", "<|endoftext|>"]
    return ["".join(chosen.choice(letters) for _ in range(chosen.randrange(1, 40))) for _ in range(120)]


@pytest.mark.parametrize("chunk_bytes, fan", [(alignment.CHUNK_BYTES, 64), (300, 3)])
def test_equals_brute_force(make_docs, work, odd_texts, chunk_bytes, fan):
    texts = [t if t is None or len(t) < 5000 else t[:3000] for t in odd_texts] + _texts()
    rows = list(enumerate(texts)) + [(3, "the same text"), (3, "the same text"), (None, "no id"), (8, "a b")]
    got = _found(make_docs(rows), work, chunk_bytes=chunk_bytes, fan=fan, shards=5)
    assert sorted(got, key=repr) == sorted(brute_force(rows), key=repr)


def test_texts_that_a_tokenizer_changes_have_no_tokens(make_docs, work):
    got = _found(make_docs([(1, "a▁b"), (2, "fine"), (3, "")]), work)
    assert {r[0]: r[1:] for r in got}[1] == (0, 0, 0, 0, 0, 0, "")
    assert {r[0]: r[1] for r in got}[2] > 0 and {r[0]: r[1] for r in got}[3] == 0


def test_very_long_text_and_word(make_docs, work, odd_texts):
    texts = [t for t in odd_texts if t and len(t) > 5000]
    got = _found(make_docs(list(enumerate(texts))), work, chunk_bytes=1000)
    assert [r[0] for r in sorted(got)] == list(range(len(texts))) and all(r[4] > 1000 for r in got)


def test_digest(make_docs, work):
    plain = _found(make_docs([(1, "one two"), (2, None)]), work + "a")
    hashed = _found(make_docs([(1, "one two"), (2, None)]), work + "b", digest=True)
    assert {r[0]: r[7] for r in hashed} == {
        1: hashlib.sha256(dict((r[0], r[7]) for r in plain)[1].encode()).hexdigest(), 2: ""}


def test_empty_table(make_docs, work):
    assert _found(make_docs([]), work) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    keys = np.unique(keys)
    made = PerfectHash.from_bytes(PerfectHash.over(keys).to_bytes())
    assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
    known = made.ordered(keys)
    assert (known[made.verified(keys, known)] == keys).all()
    with pytest.raises(ValueError):
        made.verified(keys[:1] + np.uint64(1) if n else np.array([1], dtype=np.uint64), known)
    if n == 50_000:
        assert len(made.to_bytes()) < n * 5 / 8
