"""SentencePiece encoding and decoding that keeps the byte span of every piece.

Normalization walks the text through the model's compiled character map: at each position the
longest rule that is a prefix of the rest is replaced by its text, else one character is copied.
For every byte of the normalized text the byte of the source it came from is recorded. Blanks then
become the mark U+2581, with one mark put first if the model asks for it. A piece covers a run of
normalized bytes; the alignment projects it to a span of source bytes.

The normalized text is segmented by the sentencepiece library. It normalizes once more, which leaves
a normalized text as it is; were that not so, the pieces would not fill the normalized text, and
that is checked for every text.

Defined results: a null text is an empty one, with the begin and end ids only. Bytes that are not
UTF-8 are replaced by U+FFFD before all else; spans then refer to the replaced text. Rows that share
an id are each encoded. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakewarden.llm.text import rows_of, texts_of

MARK = "▁"
MARK_BYTES = MARK.encode()

_codecs: dict[str, PieceCodec] = {}


class CharacterMap:
    """The compiled character map of a model: a double-array trie over bytes, and texts.

    The map is four bytes of trie size, the trie as 32-bit units, and zero-ended replacements. A
    unit holds a label (low byte, with bit 31 for a value), whether a value follows (bit 8), and an
    offset (from bit 10, by 256 times as much if bit 9 is set).
    """

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
            self.texts = blob[4 + size:]
        self.known: dict[int, bytes] = {}
        # Characters that begin a rule; text without any of them is copied as it is.
        self.first = {b for b in range(256) if self.units and self._child(self._root(), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        if at < len(self.units) and self.units[at] & 0x800000FF == byte:
            return at
        return None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that begins at a position."""
        if not self.units or data[at] not in self.first:
            return None
        node, best = self._root(), None
        for i in range(at, len(data)):
            child = self._child(node, data[i])
            if child is None:
                break
            node = child ^ self._offset(self.units[child])
            if self.units[child] & 0x100:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        if best[1] not in self.known:
            self.known[best[1]] = self.texts[best[1]:self.texts.index(b"\0", best[1])]
        return best[0], self.known[best[1]]

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalized bytes, and for each the source byte it came from, and the end."""
        if not self.first or not self.first.intersection(data):
            return data, np.arange(len(data) + 1)
        out, source = bytearray(), []
        at = 0
        while at < len(data):
            rule = self.longest(data, at)
            if rule:
                length, text = rule
            else:
                length = _width(data[at])
                text = data[at:at + length]
            out += text
            # A copied character keeps its bytes' places; a replaced one points to its first byte.
            source += range(at, at + length) if not rule else [at] * len(text)
            at += length
        return bytes(out), np.array([*source, len(data)])


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialized protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, message[at:at + size]
        at += size


# Numbers of fields in the model file, and their defaults.
NORMALIZER, CHARACTER_MAP, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 3, 2, 3, 4, 5
TRAINER, BLANK_SUFFIX = 2, 24


class PieceCodec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.processor = SentencePieceProcessor(model_file=path)
        model = dict(_fields(self.processor.serialized_model_proto()))
        rules = dict(_fields(model.get(NORMALIZER, b"")))
        self.map = CharacterMap(rules.get(CHARACTER_MAP, b""))
        self.prefix = bool(rules.get(DUMMY_PREFIX, 1))
        self.trims = bool(rules.get(EXTRA_BLANKS, 1))
        suffix = dict(_fields(model.get(TRAINER, b""))).get(BLANK_SUFFIX, 0)
        if suffix or not rules.get(ESCAPE_BLANKS, 1) or not self.prefix:
            raise ValueError("models that put the blank mark last, or none, are not supported")
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        self.lengths = np.array([1 if self.processor.is_byte(i) else len(p.encode())
                                 for i, p in enumerate(pieces)], dtype=np.int64)
        self.unknown = self.processor.unk_id()
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def normalized(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalized text, and the source byte of each byte of its marked form, and the end."""
        text, source = self.map.apply(data)
        if self.trims:
            blank = np.frombuffer(text, dtype=np.uint8) == 32
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            inside = np.flatnonzero(~blank)
            if not len(inside):
                return "", np.array([len(data)])
            keep[:inside[0]] = keep[inside[-1] + 1:] = False
            text = np.frombuffer(text, dtype=np.uint8)[keep].tobytes()
            source = np.append(source[:-1][keep], source[-1])
        if not text:
            return "", np.array([len(data)])
        # The first mark stands for nothing in the source; other marks are as wide as three bytes.
        blank = np.frombuffer(text, dtype=np.uint8) == 32
        widths = np.where(blank, len(MARK_BYTES), 1)
        first = np.full(len(MARK_BYTES), source[0])
        return text.decode(), np.concatenate([first, np.repeat(source[:-1], widths), source[-1:]])

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: all ids with begin and end, and begin and end of each piece's source span."""
        clean = [data.decode("utf-8", "replace") for data in texts]
        normal = [self.normalized(text.encode()) for text in clean]
        coded = self.processor.encode([text for text, _ in normal], num_threads=1)
        out = []
        for (text, source), found in zip(normal, coded, strict=True):
            ids = np.array(found, dtype=np.int64)
            lengths = self.lengths[ids]
            if self.unknown in found:  # their pieces are cut from the text, of any length
                pieces = self.processor.encode(text, out_type=str)
                lengths = np.where(ids == self.unknown, [len(p.encode()) for p in pieces], lengths)
            ends = np.cumsum(lengths)
            if (ends[-1] if len(ends) else 0) != len(source) - 1:
                raise ValueError("pieces do not fill the normalized text")
            out.append((np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32),
                        np.concatenate([[0], source[ends - lengths], source[-1:]]),
                        np.concatenate([[0], source[ends], source[-1:]])))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.processor.decode([i.tolist() for i in ids], num_threads=1)


def encoded(docs: DataFrame, model_path: str, *, with_pieces: bool = True,
            with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, covered; with_ids also ids; and
    with_pieces also begins, ends (spans in source bytes) and decoded.

    `covered` is the number of source bytes that the spans of the pieces cover.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model_path)
        for batch in batches:
            for doc_ids, texts in rows_of([batch]):
                coded = codec.encode(texts)
                back = codec.decode([c[0] for c in coded])
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(c[0]) for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c[0].astype("<u4").tobytes()).hexdigest()
                              for c in coded]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([int((c[2] - c[1]).sum()) for c in coded], pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered"]
                if with_ids:
                    columns.append(pa.array([c[0].astype(np.int32) for c in coded],
                                            pa.list_(pa.int32())))
                    names.append("ids")
                if with_pieces:
                    columns += [pa.array([c[i].astype(np.int64) for c in coded],
                                         pa.list_(pa.int64())) for i in (1, 2)]
                    columns.append(pa.array(back))
                    names += ["begins", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
              "covered bigint")
    if with_ids:
        schema += ", ids array<int>"
    if with_pieces:
        schema += ", begins array<bigint>, ends array<bigint>, decoded string"
    return texts_of(docs).mapInArrow(run, schema)
