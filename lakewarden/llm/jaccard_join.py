"""Near-duplicate classes: documents whose sets of word shingles have a Jaccard similarity of at
least PERCENT in a hundred, found with PartEnum signatures (see part_enum.py). No link is lost.

1. Documents with equal sets are one class, which gets a number; from here on a class is one text of
   its smallest doc_id. Groups of copies never meet in one task: they are counted away before the
   shuffle. Numbers are unique, also where several classes have the same smallest doc_id.
2. Signatures of all classes go through a count-min prefilter (see sketch.py); those estimated
   shared are sent to shards, one entry per batch and signature, and the shards answer which are
   shared and the smallest class behind each ("centre"). A class counts the groups in which it
   shares a signature; too few, and it cannot have a partner.
3. Candidates are verified in three rounds on the exact sets, components being formed after each:
   every class with its smallest centre; with its other centres, where they are not yet in one
   component; and all pairs of different components behind a signature that is still not settled.
   The last round compares sizes and parity maps before a pair is named, and these exclude only
   pairs that cannot be similar. So large groups of near copies come together by way of their
   centres, and pairs within a component are never listed. A signature that many share is cut into
   blocks, and every two of its blocks are compared in a group of their own.
4. Components come from smallest labels passed along links with pointer jumping, in tables.

A set holds 64-bit hashes of shingles of SHINGLE words, A-Z lower-cased; a document with fewer words
has its whole sequence as one shingle. Whether two sets are equal is decided by 128 bits.

Defined results: documents without words, with null text included, have no shingles and link with
nothing; their component is their own id. Rows that share a doc_id have one component each, by
text. Rows without doc_id are returned with a null component and link with nothing. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import part_enum
from lakewarden.llm.sketch import Sketch, bits, flags
from lakewarden.llm.substring import (
    BATCH_BYTES,
    BYTES_PER_WORD,
    batch_of,
    batches,
    merged,
    spread,
)
from lakewarden.llm.text import mix, rolling, rows_of, texts_of, window_starts, word_hashes
from lakewarden.operators.keyed import Skew, heavy_keys, salted_join

SHINGLE = 5
PERCENT = 80
# Signatures still open in the last round go to one group per so many bytes of text: they are few, and
# the fewer the groups, the less often a pair is named.
CROSSING_BYTES = 128 << 20
CHUNK = 512  # classes verified against one centre in one group
BLOCK = 4096  # members of an open signature in one group, about

_ANSWERS = "batch int, kind int, shard int, answers array<binary>"


def _sets(words: np.ndarray, counts: np.ndarray, width: int, which: int) -> list[np.ndarray]:
    starts, owner = window_starts(counts, width)
    hashes = rolling(words, width, which)[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    ends = np.searchsorted(owner, np.arange(len(counts)), "right")
    firsts = np.searchsorted(owner, np.arange(len(counts)), "left")
    upto = np.cumsum(counts)
    sets = []
    for i, n in enumerate(counts):
        if n >= width:
            ordered = np.sort(hashes[firsts[i]:ends[i]])
            new = np.ones(len(ordered), dtype=bool)
            np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
            sets.append(ordered[new])
        elif n:
            sets.append(rolling(words[upto[i] - n:upto[i]], int(n), which) + np.uint64(n))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([t.lower() for t in texts])
    return _sets(words[0], counts, width, 0)


def named_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    """As `shingle_sets`, with a 128-bit hash of each set, whose halves come from the two independent
    hashes of its shingles."""
    words, counts = word_hashes([t.lower() for t in texts])
    sets = _sets(words[0], counts, width, 0)
    names = np.zeros((len(sets), 2), dtype=np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        for column, own in ((0, sets), (1, _sets(words[1], counts, width, 1))):
            begin = np.cumsum([0, *(len(own[i]) for i in some)])[:-1]
            mixed = mix(np.concatenate([own[i] for i in some]), 31 + 2 * column)
            with np.errstate(over="ignore"):
                names[some, column] = mix(np.add.reduceat(mixed, begin)
                                          + np.bitwise_xor.reduceat(mixed, begin)).view(np.int64)
    return sets, names


def _members(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, the hash of the set, and what the row's batch follows from, per row."""
    def run(record_batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            at = 0
            for ids, texts in rows_of([batch]):
                sets, names = named_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(names[:, 0]), pa.array(names[:, 1]),
                     batch.column("spread").slice(at, len(ids))],
                    ["doc_id", "n_shingles", "h1", "h2", "spread"])
                at += len(ids)
    return texts_of(docs).withColumn("spread", spread()).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, spread bigint")


class _Classes:
    """The classes of a batch with their texts, sets and signatures."""

    def __init__(self, table: pa.Table, more: pa.Table, width: int, percent: int):
        wanted = {(r["doc"], r["h1"], r["h2"]): r["cid"] for r in more.select(
            ["kind", "cid", "doc", "h1", "h2"]).to_pylist() if r["kind"] == 2}
        ids = {d for d, _, _ in wanted}
        rows = {(i, t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(),
                                      strict=True) if i in ids}
        rows = sorted(rows)
        sets, names = named_sets([t for _, t in rows], width)
        self.ids, self.texts, self.sets = [], [], []
        for (doc_id, text), s, name in zip(rows, sets, names.tolist(), strict=True):
            cid = wanted.pop((doc_id, *name), None)
            if cid is not None:  # one text of each class, even if several rows have its doc_id
                self.ids.append(cid)
                self.texts.append(text)
                self.sets.append(s)
        found = part_enum.all_signatures(self.sets, percent)
        hashes, self.owner, self.check, self.group, self.check_owner, self.need = found
        self.cids = np.array(self.ids, dtype=np.int64)
        self.keys, self.back = np.unique(hashes, return_inverse=True)
        own = self.cids[self.owner] if len(hashes) else np.empty(0, dtype=np.int64)
        self.smallest = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.smallest, self.back, own)
        largest = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.maximum.at(largest, self.back, own)
        self.shared = largest > self.smallest


def _answers(table: pa.Table, kind: int) -> dict[int, list[bytes]]:
    return {r["shard"]: r["answers"] for r in table.select(["kind", "shard", "answers"]).to_pylist()
            if r["kind"] == kind}


def _sketched(sketch: Sketch, width: int, percent: int):
    def run(table: pa.Table, more: pa.Table) -> pa.Table:
        parts: list = []
        if len(table) and len(more):
            classes = _Classes(table, more, width, percent)
            parts = sketch.partial(classes.keys, classes.shared)
        return pa.table({"shard": pa.array([s for s, _ in parts], pa.int32()),
                         "batch": pa.array([more["batch"][0].as_py() for _ in parts], pa.int32()),
                         "blobs": pa.array([b for _, b in parts], pa.list_(pa.binary()))})
    return run


def _estimated(sketch: Sketch, width: int, percent: int):
    def run(table: pa.Table, more: pa.Table) -> pa.Table:
        rows = []
        if len(table) and len(more):
            classes = _Classes(table, more, width, percent)
            which = np.flatnonzero(sketch.repeated(classes.keys, _answers(more, 0)))
            keys, least = classes.keys[which], classes.smallest[which]
            many = classes.shared[which]
            rows = [(s, more["batch"][0].as_py(), keys[a:b].tobytes(), least[a:b].tobytes(),
                     bits(many[a:b])) for s, a, b in sketch.parts(keys)]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=["shard", "batch", "keys", "least", "many"])
    return run


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _centred(table: pa.Table) -> pa.Table:
    """Shard side: which signatures are shared, and the smallest class behind each shared one."""
    keys, least = _joined(table, "keys", np.uint64), _joined(table, "least", np.int64)
    sizes = [len(b) // 8 for b in table["keys"].to_pylist()]
    many = np.concatenate([flags(b, n) for b, n in zip(table["many"].to_pylist(), sizes,
                                                       strict=True)])
    order = np.lexsort((least, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    begin, number = np.flatnonzero(new), np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    shared |= np.bincount(number, weights=many[order]) > 0
    is_shared, centre = np.empty(len(k), dtype=bool), np.empty(len(k), dtype=np.int64)
    is_shared[order], centre[order] = shared[number], least[order][begin][number]
    ends = np.cumsum(sizes)
    answers = []
    for a, b in zip(ends - sizes, ends, strict=True):
        answers.append([bits(is_shared[a:b]), centre[a:b][is_shared[a:b]].tobytes()])
    return pa.table({"batch": table["batch"], "kind": pa.array([1] * len(table), pa.int32()),
                     "shard": table["shard"],
                     "answers": pa.array(answers, pa.list_(pa.binary()))})


_FOUND = ("batch int, cid bigint, text binary, n bigint, parity binary, centres array<bigint>, "
          "shard int, keys binary, cids binary")


def _candidates(sketch: Sketch, width: int, percent: int):
    """Rows of classes that may have a partner (with text), and rows of their shared signatures."""
    def run(table: pa.Table, more: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(table) and len(more):
            batch = more["batch"][0].as_py()
            classes = _Classes(table, more, width, percent)
            which = np.flatnonzero(sketch.repeated(classes.keys, _answers(more, 0)))
            found = _answers(more, 1)
            shared = np.zeros(len(classes.keys), dtype=bool)
            centre = np.zeros(len(classes.keys), dtype=np.int64)
            for shard, a, b in sketch.parts(classes.keys[which]):
                hit = flags(found[shard][0], b - a)
                at = which[a:b][hit]
                shared[at] = True
                centre[at] = np.frombuffer(found[shard][1], dtype=np.int64)
            use = np.flatnonzero(shared[classes.back]) if len(classes.keys) else \
                np.empty(0, dtype=np.int64)
            # Groups with a shared signature, per class and instance.
            pairs = np.unique(np.stack([classes.check[use], classes.group[use]]), axis=1)
            groups = np.bincount(pairs[0].astype(np.int64), minlength=len(classes.need))
            enough = (groups >= classes.need) & (groups > 0)
            ok = np.zeros(len(classes.ids), dtype=bool)
            ok[classes.check_owner[enough]] = True
            use = use[ok[classes.owner[use]]]
            of = classes.owner[use]
            order = np.argsort(of, kind="stable")
            at = np.flatnonzero(ok)
            begin = np.searchsorted(of[order], at, "left")
            end = np.searchsorted(of[order], at, "right")
            maps = part_enum.parities([classes.sets[i] for i in at]) if len(at) else []
            for i, a, b, bit_map in zip(at, begin, end, maps, strict=True):
                centres = np.unique(centre[classes.back[use[order[a:b]]]])
                rows.append((batch, classes.ids[i], classes.texts[i], len(classes.sets[i]),
                             bit_map.tobytes(), centres, None, None, None))
            keys = classes.keys[classes.back[use]]
            order = np.argsort(keys, kind="stable")
            keys, cids = keys[order], classes.cids[of[order]]
            for shard, a, b in sketch.parts(keys):
                rows.append((batch, None, None, None, None, None, shard, keys[a:b].tobytes(),
                             cids[a:b].tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(),
                 pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=names)
    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Texts of b travel to their a, in chunks."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sent = (pairs.join(chunks, "a")
            .withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
            .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("other")), "b")
            .select("a", "chunk", "b", "other"))
    hubs = (chunks.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("own")), "a")
            .select(F.col("a").alias("hub"), "own", F.explode(
                F.sequence(F.lit(0), F.col("chunks") - 1)).alias("hub_chunk")))

    def run(hub: pa.Table, others: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        if len(hub) and len(others):
            own = shingle_sets(hub["own"].to_pylist()[:1], width)[0]
            sets = shingle_sets(others["other"].to_pylist(), width)
            for other, s in zip(others["b"].to_pylist(), sets, strict=True):
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                common = int((own[at] == s).sum())
                if part_enum.reaches(common, len(own), len(s), percent):
                    a.append(hub["hub"][0].as_py())
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return hubs.groupBy("hub", "hub_chunk").cogroup(sent.groupBy("a", "chunk")).applyInArrow(
        run, "a bigint, b bigint")


def components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """cid, label: the smallest id reachable over links (a, b), for every id in a link."""
    both = write(links.union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("cid")).agg(
        F.least(F.min("b"), F.col("cid")).alias("label"))
    labels = write(labels, "labels")
    # Every link is there both ways, so a centre has as many links to it as from it.
    heavy = write(heavy_keys(both.groupBy("b").agg(F.count("*").alias("n")), "n", Skew()), "heavy")
    while True:
        of_b = labels.select(F.col("cid").alias("of"), "label")
        near = (salted_join(both, of_b, ["b"], ["of"], "inner", heavy=heavy)
                .groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near")))
        stepped = labels.join(near, "cid").select(
            "cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("cid").alias("label"), F.col("label").alias("up"))
        jumped = stepped.join(above, "label").select(
            "cid", "old", F.least("label", "up").alias("label"))
        jumped = write(jumped, "labels")
        labels = jumped.select("cid", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels


def _unsettled(table: pa.Table) -> pa.Table:
    """Shard side: into how many blocks the members of each signature go; 0 where all of them are in
    one component."""
    keys = _joined(table, "keys", np.uint64)
    low, high = _joined(table, "low", np.int64), _joined(table, "high", np.int64)
    found, back = np.unique(keys, return_inverse=True)
    least = np.full(len(found), np.iinfo(np.int64).max)
    most = np.full(len(found), np.iinfo(np.int64).min)
    np.minimum.at(least, back, low)
    np.maximum.at(most, back, high)
    members = np.zeros(len(found), dtype=np.int64)
    np.add.at(members, back, _joined(table, "members", np.int64))
    blocks = np.where(least < most, -(-members // BLOCK), 0)[back].astype(np.int32)
    ends = np.cumsum([len(b) // 8 for b in table["keys"].to_pylist()])
    return pa.table({"batch": table["batch"], "shard": table["shard"],
                     "blocks": pa.array([p.tobytes() for p in np.split(blocks, ends[:-1])])})


def _crossing(percent: int):
    """The last round, for some blocks of signatures: pairs of components apart that may be similar."""
    def run(table: pa.Table) -> pa.Table:
        keys = _joined(table, "keys", np.uint64)
        cids, labels, sizes = (_joined(table, c, np.int64) for c in ("cids", "labels", "sizes"))
        maps = _joined(table, "parities", np.uint64).reshape(len(cids), -1)
        sides = _joined(table, "sides", np.int8)
        # Members point into the classes of their own row.
        members, before = [], 0
        for row in table.select(["members", "cids"]).to_pylist():
            members.append(np.frombuffer(row["members"], dtype=np.int64) + before)
            before += len(row["cids"]) // 8
        member = np.concatenate(members) if members else np.empty(0, dtype=np.int64)
        order = np.lexsort((cids[member], labels[member], keys))
        edges = np.flatnonzero(np.diff(keys[order])) + 1
        found = [np.empty((0, 2), dtype=np.int64)]
        held = 0
        for part in np.split(order, edges) if len(order) else []:
            at, side = member[part], sides[part]
            if side.any():  # two blocks: only across
                first, second = at[side == 1], at[side == 2]
                begin = np.zeros(len(first), dtype=np.int64)
            else:  # by component: each member against those of the components that follow
                first = second = at
                begin = np.searchsorted(labels[at], labels[at], "right")
            for x, after in zip(first, begin, strict=True):
                rest = second[after:]
                if side.any():
                    rest = rest[labels[rest] != labels[x]]
                if len(rest):
                    rest = rest[part_enum.may_reach(maps[x], sizes[x], maps[rest], sizes[rest],
                                                    percent)]
                    pair = np.stack([np.full(len(rest), cids[x]), cids[rest]], axis=1)
                    found.append(np.sort(pair, axis=1))
                    held += len(rest)
                if held > 1 << 20:  # most pairs meet on many signatures
                    found, held = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})
    return run


def _block_pairs(keys: np.ndarray, cids: np.ndarray, blocks: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member once for every pair of blocks it takes part in: its position, the key of that pair
    of blocks, and its side (0: a block with itself, 1 and 2: the two sides of a pair)."""
    at = np.repeat(np.arange(len(keys)), blocks)
    many = blocks[at]
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (mix(cids[at].view(np.uint64), 77) % many.astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    pair = (low * many + high).astype(np.uint64)
    key = np.where(many == 1, keys[at], mix(keys[at] + mix(pair, 78), 79))
    return at, key, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)


def near_duplicates(docs: DataFrame, work: str, *, width: int = SHINGLE, percent: int = PERCENT,
                    batch_bytes: int = BATCH_BYTES, cell_bits: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id; `work` is a fresh folder that all executors can reach."""
    spark: SparkSession = docs.sparkSession
    written = 0

    def write(df: DataFrame, name: str) -> DataFrame:
        nonlocal written
        written += 1
        path = f"{work}/{name}-{written}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    def write_ids(df: DataFrame, name: str) -> DataFrame:
        """Tables of ids are small beside the texts: a few tasks a core write them, not one file
        for every shuffle partition."""
        return write(df.coalesce(2 * spark.sparkContext.defaultParallelism), name)

    members = write(_members(docs, width), "members")
    classes = (members.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2")
               .agg(F.min(F.struct("doc_id", "spread")).alias("first"), F.count("*").alias("copies")))
    # The numbers are written, so whatever runs again finds them as they were.
    classes = write_ids(classes.select(
        F.monotonically_increasing_id().alias("cid"), F.col("first.doc_id").alias("doc"),
        F.col("first.spread").alias("spread"), "h1", "h2", "copies"), "classes")
    given, size, number = batches(docs, batch_bytes=batch_bytes)
    sketch = Sketch.for_keys(size // BYTES_PER_WORD, cell_bits, depth=1, spare_bits=4)

    # Everything a batch is told has one form: its classes (kind 2), answers of shards (0 and 1).
    told = ["batch", "kind", "shard", "answers", "cid", "doc", "h1", "h2"]
    no_class = {c: F.lit(None).cast("bigint") for c in ("cid", "doc", "h1", "h2")}
    named = classes.select(
        batch_of(F.col("spread"), number).alias("batch"), F.lit(2).alias("kind"),
        F.lit(None).cast("int").alias("shard"),
        F.lit(None).cast("array<binary>").alias("answers"), "cid", "doc", "h1", "h2")
    grouped = given.groupBy("batch")
    sketches = grouped.cogroup(named.groupBy("batch")).applyInArrow(
        _sketched(sketch, width, percent), "shard int, batch int, blobs array<binary>")
    first = sketches.groupBy("shard").applyInArrow(merged(sketch), _ANSWERS)
    first = first.withColumns(no_class).select(*told)
    estimated = grouped.cogroup(named.unionByName(first).groupBy("batch")).applyInArrow(
        _estimated(sketch, width, percent),
        "shard int, batch int, keys binary, least binary, many binary")
    second = estimated.groupBy("shard").applyInArrow(_centred, _ANSWERS)
    second = second.withColumns(no_class).select(*told)
    found = write(
        grouped.cogroup(named.unionByName(first).unionByName(second).groupBy("batch"))
        .applyInArrow(_candidates(sketch, width, percent), _FOUND), "found")

    texts = found.where("cid IS NOT NULL").select("cid", "text")
    centred = found.where("cid IS NOT NULL").select("cid", "centres")
    least = F.array_min("centres")
    # Pairs are written, as they are counted and joined, and far smaller than what they come from.
    pairs = write_ids(centred.where(least < F.col("cid")).select(
        least.alias("a"), F.col("cid").alias("b")), "pairs")
    links = write_ids(_verified(pairs, texts, width, percent), "round")
    labels = components(links, write_ids)

    rest = centred.select(F.explode("centres").alias("a"), F.col("cid").alias("b"), least.alias("l"))
    rest = write_ids(_apart(rest.where("a <> b AND a <> l").select("a", "b"), labels), "pairs")
    links = links.unionByName(write_ids(_verified(rest, texts, width, percent), "round"))
    labels = components(links, write_ids)

    crossing = write_ids(_still_apart(found, labels, percent, -(-size // CROSSING_BYTES)), "pairs")
    links = links.unionByName(write_ids(_verified(crossing, texts, width, percent), "round"))
    labels = components(links, write_ids)

    # A component is named by the smallest doc_id of its classes. Most classes are their own component.
    linked = write_ids(classes.join(labels, "cid").select("label", "doc", "h1", "h2", "copies"), "linked")
    lowest = linked.groupBy(F.col("label").alias("of")).agg(F.min("doc").alias("component"))
    grown = salted_join(linked, lowest, ["label"], ["of"], "inner").select("h1", "h2", "component")
    alone = classes.join(labels.select("cid"), "cid", "left_anti").select(
        "h1", "h2", F.col("doc").alias("component"))
    component = grown.unionByName(alone).select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component")
    # A class may hold a third of all rows, so its rows are dealt over tasks by their content.
    heavy = heavy_keys(classes.select("h1", "h2", "copies"), "copies", Skew())
    joined = salted_join(members.drop("spread"), component, ["h1", "h2"], ["c1", "c2"], "left", heavy=heavy)
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
            F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")))
        .alias("component_id"))


def _labelled(pairs: DataFrame, labels: DataFrame, side: str) -> DataFrame:
    own = labels.select(F.col("cid").alias(side), F.col("label").alias(f"label_{side}"))
    return pairs.join(own, side, "left").withColumn(
        f"label_{side}", F.coalesce(f"label_{side}", side))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose sides are not in one component yet."""
    both = _labelled(_labelled(pairs, labels, "a"), labels, "b")
    return both.where("label_a <> label_b").select("a", "b")


def _still_apart(found: DataFrame, labels: DataFrame, percent: int, groups: int) -> DataFrame:
    """Pairs of different components that share a signature and may be similar enough."""
    facts = (found.where("cid IS NOT NULL")
             .select(F.col("batch").alias("of_batch"), "cid", "n", "parity")
             .join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    shared = found.where("shard IS NOT NULL").select("batch", "shard", "keys", "cids")

    def lowest(signatures: pa.Table, classes: pa.Table) -> pa.Table:
        """Per signature of a batch: its smallest and largest component."""
        label = dict(zip(classes["cid"].to_pylist(), classes["label"].to_pylist(), strict=True))
        rows = []
        for r in signatures.to_pylist():
            keys, begin, members = np.unique(np.frombuffer(r["keys"], dtype=np.uint64),
                                             return_index=True, return_counts=True)
            own = np.array([label[c] for c in np.frombuffer(r["cids"], dtype=np.int64).tolist()],
                           dtype=np.int64)
            rows.append((r["shard"], r["batch"], keys.tobytes(),
                         np.minimum.reduceat(own, begin).tobytes(),
                         np.maximum.reduceat(own, begin).tobytes(), members.tobytes()))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=["shard", "batch", "keys", "low", "high", "members"])

    ends = shared.groupBy("batch").cogroup(facts.groupBy("of_batch")).applyInArrow(
        lowest, "shard int, batch int, keys binary, low binary, high binary, members binary")
    several = ends.groupBy("shard").applyInArrow(
        _unsettled, "batch int, shard int, blocks binary")

    def open_ones(signatures: pa.Table, classes: pa.Table) -> pa.Table:
        """Members of the batch behind signatures that are not settled, with what a test takes."""
        facts_of = {c: (la, n, p) for c, la, n, p in zip(*(
            classes[x].to_pylist() for x in ("cid", "label", "n", "parity")), strict=True)}
        opened: list[tuple[np.ndarray, ...]] = []
        for r in signatures.to_pylist():
            keys, cids = np.frombuffer(r["keys"], dtype=np.uint64), np.frombuffer(r["cids"], dtype=np.int64)
            _, back = np.unique(keys, return_inverse=True)
            blocks = np.frombuffer(r["blocks"], dtype=np.int32).astype(np.int64)[back]
            if blocks.any():
                at, key, side = _block_pairs(keys, cids, blocks)
                opened.append((key, cids[at], side))
        rows = []
        if opened:
            keys, cids, sides = (np.concatenate(c) for c in zip(*opened, strict=True))
            part = (mix(keys, 80) % np.uint64(groups)).astype(np.int64)
            for p in np.unique(part).tolist():
                here = part == p
                own, members = np.unique(cids[here], return_inverse=True)
                known = [facts_of[c] for c in own.tolist()]
                rows.append((p, keys[here].tobytes(), members.astype(np.int64).tobytes(),
                             sides[here].tobytes(), own.tobytes(),
                             np.array([x[0] for x in known], dtype=np.int64).tobytes(),
                             np.array([x[1] for x in known], dtype=np.int64).tobytes(),
                             b"".join(x[2] for x in known)))
        kinds = [pa.int32()] + [pa.binary()] * 7
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=["part", "keys", "members", "sides", "cids", "labels", "sizes", "parities"])

    opened = (shared.join(several, ["batch", "shard"]).groupBy("batch")
              .cogroup(facts.groupBy("of_batch")).applyInArrow(
                  open_ones, "part int, keys binary, members binary, sides binary, cids binary, "
                             "labels binary, sizes binary, parities binary"))
    return opened.groupBy("part").applyInArrow(_crossing(percent), "a bigint, b bigint").distinct()
