import random

import public_tokenizers
import sentencepiece

from lakewarden.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
MORE = ["▁▁ a▁b", "<s> </s> <unk>", " " * 40 + "x ", "日本語テキスト", "a\x00b", "x́ ﬁ"]


def test_ids_and_spans_are_those_of_the_library(odd_texts):
    codec = P.PieceCodec.of(PATH)
    texts = [t or "" for t in odd_texts] + MORE
    coded = codec.encode([t.encode() for t in texts])
    for text, (ids, begins, ends) in zip(texts, coded, strict=True):
        assert ids.tolist() == codec.processor.encode(text, add_bos=True, add_eos=True)
        data = text.encode()
        assert begins[1:-1].tolist() == [0, *ends[1:-2].tolist()][:len(ids) - 2]
        if len(ids) > 2:
            assert ends[-2] == len(data)
        proto = codec.processor.encode(text, return_type="proto")
        for piece, a, b in zip(proto.pieces, begins[1:-1], ends[1:-1], strict=True):
            if not codec.processor.is_byte(piece.id):
                assert data[a:b] == piece.surface.encode()


def test_operator(spark, make_docs, odd_texts):
    rows = [(i % 5, t) for i, t in enumerate([*odd_texts, *MORE])] + [(None, "no id")]
    found = P.encoded(make_docs(rows), PATH).collect()
    assert len(found) == len(rows)
    codec = P.PieceCodec.of(PATH)
    want = sorted(repr((d, codec.processor.encode(t or "", add_bos=True, add_eos=True)))
                  for d, t in rows)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in found) == want
    for r in found:
        assert r["decoded"] == codec.processor.decode(r["ids"])
        assert r["n_tokens"] == len(r["ids"]) == len(r["begins"]) == len(r["ends"])
    assert P.encoded(make_docs([]), PATH).collect() == []


def test_longest_rules_of_a_compiled_map():
    """The map of the usual NFKC rules, walked here and by the library."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = dict(P._fields(dict(P._fields(normalizer.serialized_model_proto()))[3]))[2]
    table = P.CharacterMap(blob)
    chosen = random.Random(7)
    ranges = [(33, 127), (0xA0, 0x600), (0x1100, 0x1200), (0x3000, 0x3400), (0xFB00, 0xFFEF),
              (0x300, 0x370)]
    for _ in range(400):
        text = "".join(chr(chosen.randrange(*chosen.choice(ranges))) for _ in range(12))
        out, source = table.apply(text.encode())
        plain = " ".join(part for part in out.decode().split(" ") if part)
        assert normalizer.normalize(text).replace("▁", " ").strip() == plain
        assert len(source) == len(out) + 1 and source[-1] == len(text.encode())
        assert all(a <= b for a, b in zip(source, source[1:], strict=False))


def test_spans_point_behind_replaced_characters():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = dict(P._fields(dict(P._fields(normalizer.serialized_model_proto()))[3]))[2]
    out, source = P.CharacterMap(blob).apply("aﬁ㎁é".encode())
    assert out == "afinAé".encode()
    assert source.tolist() == [0, 1, 1, 4, 4, 7, 8, 9]
