"""Token-ID files: every id in the fewest bits that hold the vocabulary, in blocks.

Format. A file set is two Parquet tables in one folder, written by Spark's own writer, so that it
lies in any store and a lost executor costs no half-written file:

* `blocks`: shard, block, first (position of the block's first id within its shard), n_ids, bits,
  doc_ids and doc_starts (for each document its first id within the block, and at the end n_ids),
  payload. Id i of a block is bits i*bits to (i+1)*bits of the payload, lowest bit first. Eight ids
  fill exactly `bits` bytes, so any run of ids is cut out at a byte and unpacked with numpy.
* `shards`: shard, start (position of its first id among all ids), n_ids.

Documents lie in ascending doc_id order over shards, blocks and within a block. A block holds whole
documents and is closed once it has BLOCK_IDS ids, so only a document longer than that makes a
larger one, which is still no larger than a few times its text.

Defined results: a null text is an empty one; a document without ids has n_tokens 1 (the end id).
A null doc_id sorts first. Rows that share a doc_id are kept, ordered by text. Extra columns are
ignored. An empty table gives an empty file set.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm.byte_bpe import byte_letters
from lakewarden.llm.text import rows_of, texts_of

BLOCK_IDS = 65_536
SHARD_ROWS = 20_000  # documents in a shard, and so in a file
CACHED_WORDS = 1_000_000  # of about 200 bytes
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}  # widths at which the format is an array of numbers
# A run of these marks between a letter or digit and a blank, letter or digit is always split off.
# A mark comes first in the pattern, so that the search steps from mark to mark.
_MARKS = re.compile(rb"[.,!$%*&#|;:?](?<=[A-Za-z0-9].)[.,!$%*&#|;:?]*(?=[ \t-\rA-Za-z0-9]|\Z)")
# Words of small letters up to U+00FF alone, as UTF-8.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_PROBES = "a the word straße naïveté über ñandú øre þing ÿ aaaaaaaaaaaaaaaaaaaaaaaa".split()

BLOCKS = ("shard int, block int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, "
          "doc_starts array<bigint>, payload binary")

# Bytes of ASCII and of letters up to U+02FF; no mark that combines with a letter holds only these.
_PLAIN = bytes(b for b in range(256) if b < 0xCC)

# One tokenizer and word cache per worker process and file; filled again after a restart.
_encoders: dict[str, WordEncoder] = {}


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, lowest bit first, eight at a time."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    rows = -(-len(ids) // 8)
    padded = np.zeros(rows * 8, dtype=np.uint64)
    padded[:len(ids)] = ids
    padded = padded.reshape(rows, 8)
    out = np.zeros((rows, bits), dtype=np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        value = padded[:, j] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[:-(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from position start on, as 32-bit values; reads only the bytes that hold them."""
    if bits in _WHOLE:
        whole = np.dtype(_WHOLE[bits])
        return np.frombuffer(payload, whole, n, start * whole.itemsize).astype(np.uint32)
    first = start // 8
    rows = -(-(start + n) // 8) - first
    data = np.zeros(rows * bits, dtype=np.uint8)
    part = np.frombuffer(payload, dtype=np.uint8)[first * bits:(first + rows) * bits]
    data[:len(part)] = part
    data = data.reshape(rows, bits)
    out = np.empty((rows, 8), dtype=np.uint32)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        value = np.zeros(rows, dtype=np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= data[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[start - first * 8:][:n]


class _Known(dict):
    """Ids by word; a word that is not there is encoded and kept."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self._encode(word)
        return ids


class WordEncoder:
    """Encodes with a tokenizer of the tokenizers library, each distinct word once.

    Only for tokenizers that drop white space, ignore case, and split runs of letters, of digits and
    of other marks from each other. Then the ids of a text are those of its words in turn, and
    simple marks may be cut off a word and ASCII letters lower-cased first, which leaves far fewer
    distinct words. Letters that a combining mark may follow are left as they are, because a small
    letter can be composed with marks that its capital cannot, and the tokenizer composes first: in
    a text with characters from U+0300 on only words of ASCII alone are lower-cased. Texts that may
    hold special tokens are only cut at blanks.

    Words of small letters are what the tokenizer's first steps leave of them, up to how its vocabulary
    writes bytes, so they go to its model at once, if a few of them get the same ids that way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.direct = all(self._by_model(w.encode()) == self._whole(w.encode()) for w in _PROBES)
        self.known = _Known(self._ids)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: bytes, end_id: int) -> np.ndarray:
        if b"<|" in text:
            words = text.split()
        elif text.isascii() or not text.translate(None, _PLAIN):
            words = _MARKS.sub(rb" \g<0>", text.lower()).split()
        else:
            words = [w.lower() if w.isascii() else w for w in _MARKS.sub(rb" \g<0>", text).split()]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        ids = b"".join(map(self.known.__getitem__, words))
        return np.append(np.frombuffer(ids, dtype=self.kind), self.kind.type(end_id))

    def _ids(self, word: bytes) -> bytes:
        return self._by_model(word) if self.direct and _SMALL.fullmatch(word) else self._whole(word)

    def _by_model(self, word: bytes) -> bytes:
        letters = word.decode("latin-1").translate(self.letters)  # a letter for each byte
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, word: bytes) -> bytes:
        coded = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)
        return array(self.code, coded[0].ids).tobytes()


def _as_block(shard: int, block: int, first: int, bits: int, doc_ids: list,
              parts: list[np.ndarray]) -> pa.RecordBatch:
    starts = np.cumsum([0, *map(len, parts)])
    row = [shard, block, first, int(starts[-1]), bits, doc_ids, starts.tolist(),
           pack(np.concatenate(parts), bits)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


@dataclass(frozen=True)
class TokenFiles:
    """A written file set."""

    path: str

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str, end_id: int,
              block_ids: int = BLOCK_IDS, shard_rows: int = SHARD_ROWS) -> TokenFiles:
        """Encode all texts, append `end_id` to each, and write blocks in doc_id order."""
        # Few large files; the order of ids needs no more ranges than there are files.
        shards = max(-(-docs.count() // shard_rows),
                     docs.sparkSession.sparkContext.defaultParallelism)

        def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = WordEncoder.of(tokenizer)
            bits = bits_for(max(encoder.vocabulary, end_id + 1))
            shard = block = first = held = 0
            doc_ids: list = []
            parts: list[np.ndarray] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard = batch.column("shard")[0].as_py()
                for ids, texts in rows_of([batch]):
                    for doc_id, text in zip(ids, texts, strict=True):
                        coded = encoder.encode(text, end_id)
                        doc_ids.append(doc_id)
                        parts.append(coded)
                        held += len(coded)
                        if held >= block_ids:
                            yield _as_block(shard, block, first, bits, doc_ids, parts)
                            block, first, held = block + 1, first + held, 0
                            doc_ids, parts = [], []
            if parts:
                yield _as_block(shard, block, first, bits, doc_ids, parts)

        ordered = (texts_of(docs).repartitionByRange(shards, "doc_id")
                   .sortWithinPartitions("doc_id", "text")
                   .withColumn("shard", F.spark_partition_id()))
        ordered.mapInArrow(encoded, BLOCKS).write.parquet(f"{path}/blocks")
        written = docs.sparkSession.read.parquet(f"{path}/blocks")
        # One row per shard, that is per write task; the running sum goes over those rows only.
        totals = written.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        (totals.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
         .select("shard", "start", "n_ids").write.parquet(f"{path}/shards"))
        return cls(path)

    def blocks(self, spark: SparkSession) -> DataFrame:
        """The blocks with `start`, the position of a block's first id among all ids."""
        shards = spark.read.parquet(f"{self.path}/shards").select("shard", "start")
        return (spark.read.parquet(f"{self.path}/blocks").join(shards, "shard")
                .withColumn("start", F.col("start") + F.col("first")))

    def documents(self, spark: SparkSession, with_ids: bool = True) -> DataFrame:
        """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids.

        The checksum is that of the ids as little-endian 32-bit values.
        """
        def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                    cuts = row["doc_starts"]
                    parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = {
                        "shard": pa.array([row["shard"]] * len(parts), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "local": pa.array(np.array(cuts[:-1]) + row["first"], pa.int64()),
                        "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts],
                                              pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([p.astype(np.int32) for p in parts],
                                                  pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

        schema = "shard int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
        schema += ", ids array<int>" if with_ids else ""
        # Documents are joined to their shard's start after the ids are read, so no payload moves.
        found = spark.read.parquet(f"{self.path}/blocks").mapInArrow(opened, schema)
        shards = spark.read.parquet(f"{self.path}/shards").select("shard", "start")
        more = ["ids"] if with_ids else []
        return found.join(shards, "shard").select(
            "doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
            *more)

    def span(self, spark: SparkSession, start: int, n: int) -> np.ndarray:
        """n ids from a position among all ids on; only the blocks that hold them are read."""
        rows = (self.blocks(spark)
                .where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
                .select("start", "n_ids", "bits", "payload").orderBy("start").collect())
        parts = [np.empty(0, dtype=np.uint32)]
        for row in rows:
            skip = max(0, start - row["start"])
            take = min(row["n_ids"], start + n - row["start"]) - skip
            parts.append(unpack(bytes(row["payload"]), row["bits"], skip, take))
        return np.concatenate(parts)
