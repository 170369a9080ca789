"""Phrases of two and three words that occur together more often than their parts, per language.

A-Z are lower-cased, texts are cut at END_MARKS into pieces, and pieces at blanks and tabs into words.
A phrase that occurs a times (a >= LEAST) is cut where the score floor(10**6 * a * a / (l * r)) is lowest,
l and r being the counts of the part before the cut and after it. Phrases inside a longer one that
has COVER percent of their count are dropped.

1. Every chunk of CHUNK_BYTES of text is coded with a dictionary of its own; chunk dictionaries, not texts,
   are added up to the counts of all words. Words that occur LEAST times get numbers in SHARDS
   independent rows of numbers. Rarer words can be in no phrase, and end pieces from here on.
2. Each chunk counts its n-grams in a counting quotient filter per shard (see quotient_filter.py).
   Filters of a shard are merged in a tree, FAN at a time, shards being divided further on the way, so
   that a merge holds about SHARD_ENTRIES entries at every level, whatever the size of the table. A
   phrase that a third of all texts repeat is one entry per chunk.
3. Of the merged counts those of LEAST and more are kept: they and the words hold all the counts that
   scores take, since no part of a phrase occurs less often than it. Arithmetic is in whole decimals.

Defined results: null texts are empty; a null lang is `und`, together with a lang of that name. Every row
is counted, whatever its doc_id. Extra columns are ignored. An empty table gives no rows. Counts up to
10**14 are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm import quotient_filter as qf
from lakewarden.llm.text import texts_of

LEAST = 10
COVER = 50
TOP = 2000
NO_LANG = "und"
CHUNK_BYTES = 4 << 20
SHARDS = 256  # of the dictionary
FAN = 256
SHARD_ENTRIES = 1 << 21

END_MARKS = b".,;:!?\n\v\f\r"
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(_END[0] if b in END_MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNT = "decimal(14,0)"


class _Codes(dict):
    """Codes of a language's words, drawn from the chunk's list when a word is first met."""

    def __init__(self, lang: str, found: list[tuple[str, bytes]]):
        super().__init__({_END: 0})
        self.lang, self.found = lang, found

    def __missing__(self, word: bytes) -> int:
        self.found.append((self.lang, word))
        self[word] = len(self.found)
        return self[word]


_CHUNKS = "chunk bigint, codes binary, words array<struct<lang:string,word:binary,n:bigint>>"


def _coded(chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        found: list[tuple[str, bytes]] = []
        by_lang: dict[str, _Codes] = {}
        parts: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            counts = np.bincount(codes, minlength=len(found) + 1)[1:]
            words = pa.StructArray.from_arrays(
                [pa.array([w[0] for w in found], pa.string()), pa.array([w[1] for w in found], pa.binary()),
                 pa.array(counts, pa.int64())], ["lang", "word", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([codes.astype("<u4").tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), words)],
                ["chunk", "codes", "words"])

        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for lang, text in zip(langs, texts, strict=True):
                name, raw = lang.as_py(), text.as_py()
                codes = by_lang.get(name)
                if codes is None:
                    codes = by_lang[name] = _Codes(name, found)
                words = raw.translate(_TABLE).replace(_END, b" \xff ").split()
                words.append(_END)
                parts.append(np.array(list(map(codes.__getitem__, words)), dtype=np.int64))
                size += len(raw)
                if size >= chunk_bytes:
                    yield closed()
                    chunk, size = chunk + 1, 0
                    found, by_lang, parts = [], {}, []
        if parts:
            yield closed()
    return run


def _filters(layouts: list[qf.Layout], shard_bits: list[int]):
    """The filters of one chunk; `words`: which of its codes have a number."""
    def run(table: pa.Table, words: pa.Table) -> pa.Table:
        rows = []
        if len(table):
            codes = np.frombuffer(table["codes"][0].as_py(), dtype="<u4")
            ids = np.zeros(int(codes.max()) + 1, dtype=np.int64)
            ids[words["code"].to_numpy()] = words["id"].to_numpy()
            sequence = ids[codes]
            known = sequence > 0
            for layout, own_bits in zip(layouts, shard_bits, strict=True):
                n = layout.n
                if len(sequence) < n:
                    continue
                whole = known[:len(known) - n + 1].copy()
                for i in range(1, n):
                    whole &= known[i:len(known) - n + 1 + i]
                at = np.flatnonzero(whole)
                ids_at = np.stack([sequence[at + i] for i in range(n)], axis=1)
                numbers = qf.distinct(layout, *layout.packed(ids_at))
                rows += [(n, shard, table["node"][0].as_py(), blob)
                         for shard, blob in qf.split(layout, own_bits, *numbers)]
        return _as_table(rows)
    return run


_FILTERS = "n int, shard bigint, node bigint, filter binary"


def _as_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    names=["n", "shard", "node", "filter"])


def _merged(layouts: list[qf.Layout], table: pa.Table, shard_bits: list[int]):
    n, shard = table["n"][0].as_py(), table["shard"][0].as_py()
    at = next(i for i, layout in enumerate(layouts) if layout.n == n)
    return at, qf.merged(layouts[at], shard_bits[at], shard, table["filter"].to_pylist())


def _divided(layouts: list[qf.Layout], shard_bits: list[int], next_bits: list[int], nodes: int):
    """One level up: the filters of a node, merged and divided among the next level's shards."""
    def run(table: pa.Table) -> pa.Table:
        at, numbers = _merged(layouts, table, shard_bits)
        node = table["node"][0].as_py() % nodes
        return _as_table([(layouts[at].n, shard, node, blob)
                          for shard, blob in qf.split(layouts[at], next_bits[at], *numbers)])
    return run


def _frequent(layouts: list[qf.Layout], shard_bits: list[int], least: int):
    """The top: n-grams of a shard that occur often enough, as ids again."""
    def run(table: pa.Table) -> pa.Table:
        at, (high, low, counts) = _merged(layouts, table, shard_bits)
        often = counts >= least
        ids = layouts[at].unpacked(high[often], low[often])
        columns = [pa.array(ids[:, i] if i < ids.shape[1] else np.zeros(len(ids), dtype=np.int64), pa.int64())
                   for i in range(3)]
        return pa.table([*columns, pa.array(counts[often])], names=["w1", "w2", "w3", "a"])
    return run


def counted_ngrams(chunks: DataFrame, ids: DataFrame, id_bits: int, words: int, least: int = LEAST,
                   fan: int = FAN, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """w1, w2, w3 (0: none) and a of all pairs and triples that occur `least` times.

    `chunks`: chunk, codes; `ids`: of_chunk, code, id; `words`: how many words there are in all.
    """
    number = max(1, chunks.count())
    nodes = [-(-number // fan)]
    while nodes[-1] > 1:
        nodes.append(-(-nodes[-1] // fan))
    layouts = [qf.Layout(n, max(8, id_bits)) for n in (2, 3)]
    wanted = max(0, int(words - 1).bit_length() - (shard_entries - 1).bit_length())
    bits = [[min(wanted * (level + 1) // len(nodes), layout.high_bits) for layout in layouts]
            for level in range(len(nodes))]
    given = chunks.select("chunk", "codes", F.pmod(F.xxhash64("chunk"), F.lit(nodes[0])).alias("node"))
    filters = given.groupBy("chunk").cogroup(ids.groupBy("of_chunk")).applyInArrow(
        _filters(layouts, bits[0]), _FILTERS)
    for level in range(1, len(nodes)):
        filters = filters.groupBy("n", "shard", "node").applyInArrow(
            _divided(layouts, bits[level - 1], bits[level], nodes[level]), _FILTERS)
    return filters.groupBy("n", "shard").applyInArrow(
        _frequent(layouts, bits[-1], least), "w1 bigint, w2 bigint, w3 bigint, a bigint")


def _score(a: str, left: str, right: str) -> Column:
    whole = {c: f"CAST({c} AS {_COUNT})" for c in (a, left, right)}
    return F.expr(f"({whole[a]} * {whole[a]} * CAST(1000000 AS DECIMAL(7,0))) "
                  f"div ({whole[left]} * {whole[right]})")


def _with_words(rows: DataFrame, words: DataFrame, column: str, **columns: str) -> DataFrame:
    """Columns of the word behind an id. Spark splits a very common word's rows (adaptive skew join)."""
    return rows.join(words.select(F.col("id").alias(column), *[
        F.col(c).alias(n) for n, c in columns.items()]), column)


def phrases(docs: DataFrame, work: str, *, least: int = LEAST, cover: int = COVER, top: int = TOP,
            chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    Ordered by score, then count, both descending, then by the bytes of the phrase. `work` is a fresh
    folder that all executors can reach.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    chunks = written(texts_of(docs, lang).select("lang", "text").mapInArrow(_coded(chunk_bytes), _CHUNKS), "chunks")
    entries = (chunks.select("chunk", F.posexplode("words").alias("at", "w"))
               .select("chunk", (F.col("at") + 1).alias("code"), "w.lang", "w.word", "w.n"))
    counts = written(entries.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    shard = F.pmod(F.xxhash64("lang", "word"), F.lit(SHARDS))
    in_shard = Window.partitionBy("shard").orderBy("lang", "word")
    words = written(
        counts.where(F.col("f") >= least).withColumn("shard", shard)
        .withColumn("id", (F.row_number().over(in_shard) - 1).cast("bigint") * SHARDS + F.col("shard") + 1)
        .drop("shard"), "words")
    facts = words.agg(F.coalesce(F.max("id"), F.lit(1)).alias("ids"),
                      F.coalesce(F.sum("f"), F.lit(1)).alias("words")).first()
    if facts["ids"] >= 1 << 32:
        raise ValueError("more words than a number of 32 bits can tell apart")
    ids = entries.drop("n").join(words.drop("f"), ["lang", "word"]).select(
        F.col("chunk").alias("of_chunk"), "code", "id")
    grams = written(counted_ngrams(chunks.select("chunk", "codes"), ids, int(facts["ids"]).bit_length(),
                                   facts["words"], least, fan, shard_entries), "grams")

    pairs = grams.where("w3 = 0").select("w1", "w2", "a")
    triples = grams.where("w3 <> 0")
    scored_pairs = _with_words(_with_words(pairs, words, "w1", l="f", lang="lang"), words, "w2", r="f")
    inside = (triples.select("a", F.explode(F.array(
        F.struct(F.col("w1").alias("i1"), F.col("w2").alias("i2")),
        F.struct(F.col("w2").alias("i1"), F.col("w3").alias("i2")))).alias("p"))
        .groupBy("p.i1", "p.i2").agg(F.max("a").alias("longer")))
    kept = (scored_pairs.join(inside, (F.col("w1") == F.col("i1")) & (F.col("w2") == F.col("i2")), "left")
            .where(f"longer IS NULL OR 100 * longer < {cover} * a")
            .select("lang", "w1", "w2", F.lit(0).cast("bigint").alias("w3"), "a", "l", "r",
                    _score("a", "l", "r").alias("score")))

    def pair_count(first: str, second: str, out: str) -> DataFrame:
        return pairs.select(F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(out))

    ends = _with_words(_with_words(triples, words, "w1", l1="f", lang="lang"), words, "w3", r2="f")
    cut = (ends.join(pair_count("w2", "w3", "r1"), ["w2", "w3"]).join(pair_count("w1", "w2", "l2"), ["w1", "w2"])
           .withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")}))
    second = F.col("s2") < F.col("s1")
    scored_triples = cut.select(
        "lang", "w1", "w2", "w3", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = kept.unionByName(scored_triples).withColumn("place", F.rank().over(best)).where(
        F.col("place") <= top).drop("place")
    # Up to here phrases are ids; only those that may be reported get their texts.
    texts = written(near, "near")
    for i in (1, 2):
        texts = _with_words(texts, words, f"w{i}", **{f"t{i}": "word"})
    third = words.select(F.col("id").alias("w3"), F.col("word").alias("t3"))
    phrase = F.concat_ws(" ", *[F.col(f"t{i}").cast("string") for i in (1, 2, 3)])
    texts = texts.join(third, "w3", "left").select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = texts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
