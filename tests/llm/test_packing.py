"""Differencing, and packing as a round trip against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakewarden.llm import packing
from lakewarden.llm.byte_bpe import ByteEncoder
from lakewarden.llm.queries import BYTE_BPE, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path(BYTE_BPE))


def test_encoder_equals_the_library(tokenizer, odd_texts):
    chosen = random.Random(3)
    letters = list("ab XY.,'’  \n\t\r\v\x1c\x85  é́日👍🏽²½٣\x00_<|>") + ["'s", "'LL", "<|endoftext|>"]
    texts = [t or "" for t in odd_texts] + [" " * 3000 + "x", "\n \t" * 2000, "a" * 20_000] + [
        "".join(chosen.choice(letters) for _ in range(chosen.randrange(30))) for _ in range(3000)]
    for special in (True, False):
        tokenizer.encode_special_tokens = not special
        encoder = ByteEncoder.of(tokenizer_path(BYTE_BPE), special)
        for text in texts:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert encoder.encode(text) == ids
            if not special:
                assert b"".join(encoder.tokens[i] for i in ids) == text.encode()
    tokenizer.encode_special_tokens = False


def test_differencing_of_two_windows_by_hand():
    # 8, 7, 6, 5, 4: 8-7 = 1, 6-5 = 1, 4-1 = 3, 3-1 = 2; sums 14 and 16.
    fill, windows = packing.differenced(np.array([8, 7, 6, 5, 4]), 2)
    assert fill.tolist() == [16, 14]
    assert sorted(i for w in windows for i in w.tolist()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_windows_hold_every_piece_once_and_nothing_beyond_capacity(n):
    sizes = np.random.default_rng(n).integers(1, 513, n)
    windows = packing.fitting(sizes)
    assert sorted(np.concatenate(windows).tolist()) == list(range(n))
    assert max(int(sizes[w].sum()) for w in windows) <= packing.CAPACITY
    if n == 300:
        assert len(windows) <= sizes.sum() / packing.CAPACITY * 1.03 + 1


def test_window_count_rises_where_pieces_do_not_fit():
    assert len(packing.fitting(np.array([6, 6, 6]), 10)) == 3  # two windows would hold 20 ids


def _check(tokenizer, given, found, capacity):
    """Every id of every row in one piece, windows gapless and within capacity."""
    by_document, by_window = {}, {}
    for r in found:
        by_document.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    for members in by_window.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    want = {}
    for doc_id, text in given:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault((doc_id, len(ids)), []).append(ids)
    assert set(want) == set(by_document)
    for key, rows in want.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_document[key])
        cut = sorted((a, n, zlib.crc32(ids[a:a + n].tobytes()))
                     for ids in rows for a, n in packing.cuts(len(ids), capacity, capacity // 4))
        assert pieces == cut
        assert sum(n for _, n, _ in pieces) == sum(len(ids) for ids in rows)
    return sum(capacity - sum(r["length"] for r in m) for m in by_window.values())


def test_packing(spark, make_docs, odd_texts, tokenizer, work):
    given = list(enumerate(odd_texts)) + [(5, "a"), (5, "a"), (5, "other text"), (None, "no id"),
                                          (None, "no id"), (77, "a <|endoftext|> b")]
    found = packing.packed(make_docs(given), tokenizer_path(BYTE_BPE), 1, work, capacity=64, piece=16,
                           group=100).collect()
    _check(tokenizer, given, found, 64)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_little_padding(spark, tokenizer, work):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = [tuple(r) for r in docs.collect()]
    found = packing.packed(docs, tokenizer_path(BYTE_BPE), 1, work, with_ids=False).collect()
    padding = _check(tokenizer, given, found, packing.CAPACITY)
    assert padding < 0.02 * sum(r["length"] for r in found)


def test_padded_windows(spark, make_docs, tokenizer, work):
    given = [(1, "one two three"), (2, "four"), (3, "five " * 100)]
    pieces = packing.packed(make_docs(given), tokenizer_path(BYTE_BPE), 1, work, capacity=32, piece=8)
    full = packing.windows(pieces, 9, 32).collect()
    assert all(len(r["ids"]) == 128 for r in full)
    parts = {(r["sequence_id"], r["offset"]): r for r in pieces.collect()}
    by_id = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in full}
    for (sequence, offset), r in parts.items():
        assert by_id[sequence][offset:offset + r["length"]].tobytes() == bytes(r["ids"])
    for r in full:
        assert (by_id[r["sequence_id"]][r["n_ids"]:] == 9).all()


def test_empty_table(make_docs, work):
    found = packing.packed(make_docs([]), tokenizer_path(BYTE_BPE), 1, work)
    assert found.collect() == [] and packing.windows(found, 0).collect() == []
