import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakewarden.llm.token_files import TokenFiles, WordEncoder, bits_for, pack, unpack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packed_ids_come_back_from_any_place(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    payload = pack(ids, bits)
    assert len(payload) == -(-1003 * bits // 8)
    for start, n in ((0, 1003), (5, 11), (8, 16), (1002, 1), (500, 0)):
        assert (unpack(payload, bits, start, n) == ids[start:start + n]).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        pack(np.array([8], dtype=np.uint32), 3)


def test_files_hold_what_the_library_gives(spark, make_docs, odd_texts, work):
    texts = [*odd_texts, "THE Thing's $$$ they'll..'s <|endoftext|> <|ENDOFTEXT|>.", "ΑΣ Σ. Ĳ"]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (1000, "again")]
    files = TokenFiles.write(make_docs(rows), work, PATH, 2, block_ids=50)
    got = files.documents(spark).collect()
    tokenizer, expected, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    everything = [i for row in expected for i in row[4]]
    for at, n in ((0, 5), (start - 3, 3), (47, 120), (10, 0)):
        assert files.span(spark, at, n).tolist() == everything[at:at + n]


def test_no_documents(spark, make_docs, work):
    files = TokenFiles.write(make_docs([]), work, PATH, 2)
    assert files.documents(spark).collect() == []


def test_capitals_with_marks_that_only_small_letters_compose_with(spark, make_docs, work):
    pairs = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [*pairs, *[f"Two {p}S, A.{p} ({p}'s) {p.lower()} Él" for p in pairs],
             "J\u0323\u030c J\u0591\u030c E\u0301", " ".join(pairs), "".join(pairs),
             "ÉL Über FÜR J", "THE \u2014 END\u2019S J\u030c <|x|>"]
    files = TokenFiles.write(make_docs(list(enumerate(texts))), work, PATH, 2)
    got = {r["doc_id"]: r["ids"] for r in files.documents(spark).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
                   for i, t in enumerate(texts)}


def test_words_of_small_letters_go_to_the_model_at_once(monkeypatch):
    encoder, whole = WordEncoder(PATH), Tokenizer.from_file(PATH)
    chosen = np.random.default_rng(3)
    letters = list("aeinrst" * 3 + "abcdefghijklmnopqrstuvwxyzßàéñöø÷ÿ")
    words = ["".join(chosen.choice(letters, chosen.integers(1, 30))) for _ in range(3000)]
    plain = [w for w in words if "÷" not in w]
    asked = []
    monkeypatch.setattr(encoder, "_whole", lambda w, get=encoder._whole: asked.append(w) or get(w))
    encoder.encode(" ".join(plain).encode(), 2)
    assert asked == []
    for text in (" ".join(plain), " ".join(words), "Ab, Ab.cd Éa, ñ...! x;y ?", "a " * 3 + "1a a1 .a a."):
        assert encoder.encode(text.encode(), 2).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_the_cache_is_emptied_between_texts(monkeypatch):
    from lakewarden.llm import token_files
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    encoder, whole = WordEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(20):
        text = " ".join(f"word{j} été" for j in range(i))
        assert encoder.encode(text.encode(), 2).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert len(encoder.known) <= 5 + 2 * 20
