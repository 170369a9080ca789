"""Aligning the tokens of two tokenizers, with document counts of the pairs of ids that overlap.

A is a byte-level BPE file of the tokenizers library, over blank + text; B a sentencepiece model, over
the text, to which it adds the blank. Where the bytes of all A tokens, of all B tokens, and of
blank + text are the same, tokens lie side by side: byte offsets at which both end cut them into
groups, and every stretch between two neighbouring ends is one pair of tokens that overlap (a link).

1. Documents are encoded and aligned in chunks of CHUNK_BYTES of text. A chunk keeps the alignment (for
   each document its pairs and how often each links, which is a fraction of its ids), and sends each
   shard of the id pairs its distinct pairs with the number of its documents that hold them. All
   pairs of one A id lie in one shard; there are SHARDS of them, so a shard can hold no more than its
   part of the two vocabularies, whatever the size of the table.
2. Per shard the distinct pairs of all chunks are united in a tree, FAN messages at a time, and get a
   minimal perfect hash (perfect_hash.py).
3. Chunks' counts become dense vectors indexed by that hash, which are summed up the same tree. Keys are
   verified, so no pair is counted under another's number.
4. Every message is answered with the counts of its pairs and whether each is the highest of its A id.
5. A second pass over the chunks goes through the links again and looks their counts up.

No task holds more than FAN messages of a shard, its table, or one chunk with its answers.

Defined results: null and empty texts, and texts whose bytes a tokenizer does not keep, have no
tokens: all numbers 0, groups ''. Rows that share a doc_id, copies included, are documents of their own.
Rows without doc_id are counted and returned as well. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.byte_bpe import ByteEncoder
from lakewarden.llm.perfect_hash import PerfectHash
from lakewarden.llm.sketch import bits, flags
from lakewarden.llm.text import mix, rows_of, texts_of

CHUNK_BYTES = 6 << 20
BLOCK_BYTES = 1 << 18  # text encoded and aligned at a time, but for longer documents
SHARDS = 64
FAN = 64

_FACTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_CHUNKS = ("chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
           "n_links array<bigint>, groups array<string>, n_pairs binary, pairs binary, times binary, "
           "sent array<struct<shard:int,keys:binary,counts:binary>>")
_BLANK_MARK = "▁"
_models: dict[str, PieceModel] = {}


class PieceModel:
    """A sentencepiece model; `tokens` are the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                               else piece.replace(_BLANK_MARK, " ").encode())

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]


class Aligned:
    """The links of a chunk: for each link its document and the positions of its two tokens."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
                 sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        end_a, end_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        size = int(end_a[-1]) if len(a) else 0
        marks = np.zeros(size + 1, dtype=np.uint8)
        marks[end_a] |= 1
        marks[end_b] |= 2
        ends = np.flatnonzero(marks)
        kind = marks[ends]
        is_a, is_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
        # Ends before this one, so the token that covers the stretch up to it.
        self.of_a, self.of_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        self.both = kind == 3
        first_a = np.cumsum(n_a) - n_a
        tokens = np.searchsorted(first_a + n_a, self.of_a, "right")
        self.document = tokens
        self.keys = (a[self.of_a].astype(np.uint64) << np.uint64(32)) | b[self.of_b].astype(np.uint64)

    def per_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links, for each pair of a document; ordered."""
        order = np.lexsort((self.keys, self.document))
        keys, document = self.keys[order], self.document[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
        at = np.flatnonzero(new)
        return document[at], keys[at], np.diff(at, append=len(keys))

    def groups(self) -> list[str]:
        """Ids of each document's groups: A ids, a bar, B ids; groups parted by semicolons."""
        group = np.cumsum(self.both) - self.both
        sides = []
        for of, n in ((self.of_a, len(self.a)), (self.of_b, len(self.b))):
            # A token's group is that of its last stretch; so is every other stretch of it.
            own = np.empty(n, dtype=np.int64)
            own[of] = group
            last = np.ones(n, dtype=bool)
            last[:-1] = own[1:] != own[:-1]
            sides.append((own, last))
        (group_a, last_a), (group_b, last_b) = sides
        # A before B within a group; each id with the mark that follows it.
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        marked = np.concatenate([4 * self.a + last_a, 4 * self.b + 2 * last_b])[order]
        words = list(map(_marked(1 << int(marked.max(initial=0)).bit_length()).__getitem__, marked.tolist()))
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(words[at:at + n])[:-1])
            at += n
        return out


@cache
def _marked(n: int) -> list[str]:
    """Text of the number i // 4 with the mark i % 4."""
    return [f"{i >> 2}{',|;'[i & 3]}" if i & 3 < 3 else "" for i in range(n)]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By A id, so that the highest count of an A id is known in its shard."""
    return (mix(keys >> np.uint64(32), 71) % np.uint64(shards)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Positions of the keys of each shard that has any, in order."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    found, begin = np.unique(shard[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:]), strict=True)) if len(keys) else []


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in one, two or four bytes each, with the width in front."""
    width = next(w for w in (1, 2, 4) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


class _Chunk:
    """The alignment of a chunk's documents, as it is written."""

    def __init__(self):
        self.facts: dict[str, list] = {c: [] for c in _FACTS}
        self.documents: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_ids: list, aligned: Aligned, digest: bool) -> None:
        n, before = len(doc_ids), len(self.facts["doc_id"])
        document, keys, times = aligned.per_document()
        groups = aligned.groups()
        if digest:
            groups = [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
        both = np.bincount(aligned.document[aligned.both], minlength=n)
        links = np.bincount(aligned.document, minlength=n)
        for column, values in zip(_FACTS, (doc_ids, aligned.n_a.tolist(), aligned.n_b.tolist(),
                                           both.tolist(), links.tolist(), groups), strict=True):
            self.facts[column] += values
        self.documents.append(document + before)
        self.keys.append(keys)
        self.times.append(times)

    def closed(self, chunk: int, shards: int) -> pa.RecordBatch:
        keys, back, counts = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        n_pairs = np.bincount(np.concatenate(self.documents), minlength=len(self.facts["doc_id"]))
        sent = [{"shard": s, "keys": keys[at].tobytes(), "counts": counts[at].astype("<u4").tobytes()}
                for s, at in _by_shard(keys, shards)]
        blob = pa.struct([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
        columns = [pa.array([chunk], pa.int64())]
        columns += [pa.array([self.facts[c]], pa.list_(pa.string() if c == "groups" else pa.int64()))
                    for c in _FACTS]
        columns += [pa.array([_narrow(v)], pa.binary()) for v in (n_pairs, back, np.concatenate(self.times))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sent], pa.list_(blob))], [
            "chunk", *_FACTS, "n_pairs", "pairs", "times", "sent"])


def _encoded(tokenizer_a: str, model_b: str, chunk_bytes: int, shards: int, digest: bool):
    """Chunks of encoded and aligned documents."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = ByteEncoder.of(tokenizer_a, special=False), PieceModel.of(model_b)
        bytes_a, bytes_b = encoder.tokens, pieces.tokens
        sizes = tuple(np.array([len(t) for t in tokens]) for tokens in (bytes_a, bytes_b))
        number = TaskContext.get().partitionId() << 33
        chunk, size = _Chunk(), 0

        def block(doc_ids: list, texts: list[bytes]) -> None:
            ids_a: list[int] = []
            ids_b: list[int] = []
            n_a, n_b = [], []
            whole = [t.decode("utf-8", "replace") for t in texts]
            for text, raw, b in zip(whole, texts, pieces.model.encode(whole, num_threads=1), strict=True):
                given = b" " + raw
                a: list[int] = []
                if raw and b"".join(map(bytes_b.__getitem__, b)) == given:
                    a = encoder.encode(" " + text)
                if not a or b"".join(map(bytes_a.__getitem__, a)) != given:
                    a, b = [], []
                n_a.append(len(a))
                n_b.append(len(b))
                ids_a += a
                ids_b += b
            chunk.add(doc_ids, Aligned(*(np.array(v, dtype=np.int64) for v in (ids_a, ids_b, n_a, n_b)), *sizes),
                      digest)

        for batch in batches:
            for doc_ids, texts in rows_of([batch]):
                begin = held = 0
                for i, raw in enumerate(texts):
                    held += len(raw) + 64
                    if held >= BLOCK_BYTES or size + held >= chunk_bytes or i + 1 == len(texts):
                        block(doc_ids[begin:i + 1], texts[begin:i + 1])
                        size, begin, held = size + held, i + 1, 0
                    if size >= chunk_bytes:
                        yield chunk.closed(number, shards)
                        chunk, size, number = _Chunk(), 0, number + 1
        if size:
            yield chunk.closed(number, shards)
    return run


def _united(table: pa.Table) -> pa.Table:
    """The distinct keys of some messages of a shard."""
    keys = [np.frombuffer(k, dtype=np.uint64) for k in table["keys"].to_pylist()]
    return pa.table({"shard": table["shard"].slice(0, 1), "node": table["above"].slice(0, 1),
                     "keys": pa.array([np.unique(np.concatenate(keys)).tobytes()], pa.binary())})


def _hashed(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(k, dtype=np.uint64)
                                     for k in table["keys"].to_pylist()]))
    made = PerfectHash.over(keys)
    return pa.table({"shard": table["shard"].slice(0, 1),
                     "hash": pa.array([made.to_bytes()], pa.binary()),
                     "known": pa.array([made.ordered(keys).tobytes()], pa.binary())})


def _counted(table: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense vector of counts of some messages of a shard."""
    made = PerfectHash.from_bytes(hashes["hash"][0].as_py())
    known = np.frombuffer(hashes["known"][0].as_py(), dtype=np.uint64)
    total = np.zeros(made.size, dtype=np.int64)
    for keys, counts in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        total[made.verified(np.frombuffer(keys, dtype=np.uint64), known)] += np.frombuffer(
            counts, dtype="<u4")
    return pa.table({"shard": table["shard"].slice(0, 1), "node": table["above"].slice(0, 1),
                     "vector": pa.array([total.tobytes()], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, dtype=np.int64) for v in table["vector"].to_pylist())
    return pa.table({"shard": table["shard"].slice(0, 1), "node": table["above"].slice(0, 1),
                     "vector": pa.array([total.tobytes()], pa.binary())})


def _answered(table: pa.Table, counted: pa.Table) -> pa.Table:
    """Per message the counts of its keys, and which of them are the highest of their A id."""
    made = PerfectHash.from_bytes(counted["hash"][0].as_py())
    known = np.frombuffer(counted["known"][0].as_py(), dtype=np.uint64)
    total = np.frombuffer(counted["vector"][0].as_py(), dtype=np.int64)
    found, back = np.unique(known >> np.uint64(32), return_inverse=True)
    highest = np.zeros(len(found), dtype=np.int64)
    np.maximum.at(highest, back, total)
    best = total == highest[back]
    rows = []
    for chunk, shard, keys in zip(table["chunk"].to_pylist(), table["shard"].to_pylist(),
                                  table["keys"].to_pylist(), strict=True):
        at = made.verified(np.frombuffer(keys, dtype=np.uint64), known)
        rows.append((chunk, shard, total[at].tobytes(), bits(best[at])))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    names=["of_chunk", "shard", "counts", "best"])


_RESULT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
           "count_sum bigint, groups string")


def _looked_up(shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        n = len(table["doc_id"][0])
        keys = np.sort(np.concatenate([np.empty(0, dtype=np.uint64), *(
            np.frombuffer(m["keys"], dtype=np.uint64) for m in table["sent"][0].as_py())]))
        counts = np.zeros(len(keys), dtype=np.int64)
        best = np.zeros(len(keys), dtype=bool)
        given = {r["shard"]: r for r in answers.to_pylist()}
        for shard, at in _by_shard(keys, shards):
            counts[at] = np.frombuffer(given[shard]["counts"], dtype=np.int64)
            best[at] = flags(given[shard]["best"], len(at))
        n_pairs, pairs, times = (_wide(table[c][0].as_py()) for c in ("n_pairs", "pairs", "times"))
        ends = np.cumsum(n_pairs)

        def per_document(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return pa.array(sums[ends] - sums[ends - n_pairs], pa.int64())

        facts = {c: table[c].chunk(0).flatten() if n else pa.array([], table[c].type.value_type)
                 for c in _FACTS}
        return pa.table({**{c: facts[c] for c in _FACTS[:-1]}, "n_best": per_document(times * best[pairs]),
                         "count_sum": per_document(times * counts[pairs]), "groups": facts["groups"]})
    return run


def aligned(docs: DataFrame, tokenizer_a: str, model_b: str, work: str, *, digest: bool = False,
            chunk_bytes: int = CHUNK_BYTES, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (with `digest`: their sha256).

    `work` is a fresh folder that all executors can reach.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    chunks = written(texts_of(docs).mapInArrow(
        _encoded(tokenizer_a, model_b, chunk_bytes, shards, digest), _CHUNKS), "chunks")
    sent = chunks.select("chunk", F.inline("sent"))
    # Chunks are dealt to the lowest nodes of the tree; every level has a FAN-th of the nodes.
    nodes = max(1, -(-chunks.count() // fan))
    node = F.pmod(F.xxhash64("chunk"), F.lit(nodes)).cast("int")
    sent = sent.withColumn("above", node)

    def up(df: DataFrame, step, schema: str) -> DataFrame:
        """From the lowest nodes to one row per shard."""
        level = nodes
        while level > 1:
            level = -(-level // fan)
            df = df.withColumn("above", F.pmod("node", F.lit(level)).cast("int"))
            df = df.groupBy("shard", "above").applyInArrow(step, schema)
        return df

    keys = sent.select("shard", "above", "keys").groupBy("shard", "above").applyInArrow(
        _united, "shard int, node int, keys binary")
    hashes = written(up(keys, _united, "shard int, node int, keys binary").groupBy("shard").applyInArrow(
        _hashed, "shard int, hash binary, known binary"), "hashes")

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node")
    at_nodes = hashes.select(F.col("shard").alias("of_shard"), everywhere, "hash", "known")
    vectors = sent.groupBy("shard", "above").cogroup(at_nodes.groupBy("of_shard", "node"))
    summed = up(vectors.applyInArrow(_if_both(_counted), "shard int, node int, vector binary"), _summed,
                "shard int, node int, vector binary")
    counted = written(hashes.join(summed.drop("node"), "shard"), "counts")

    at_nodes = counted.select(F.col("shard").alias("of_shard"), everywhere, "hash", "known", "vector")
    answers = sent.groupBy("shard", "above").cogroup(at_nodes.groupBy("of_shard", "node")).applyInArrow(
        _if_both(_answered), "of_chunk bigint, shard int, counts binary, best binary")
    kept = chunks.withColumn("sent", F.transform("sent", lambda m: F.struct(m["keys"].alias("keys"))))
    return kept.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(
        _looked_up(shards), _RESULT)


def _if_both(step):
    """A node to which no chunk was dealt has nothing to do."""
    def run(table: pa.Table, other: pa.Table) -> pa.Table:
        if len(table):
            return step(table, other)
        names = {_counted: ["shard", "node", "vector"],
                 _answered: ["of_chunk", "shard", "counts", "best"]}[step]
        return pa.table({n: pa.array([], pa.int64() if n == "of_chunk" else pa.int32()
                                     if n in ("shard", "node") else pa.binary()) for n in names})
    return run
