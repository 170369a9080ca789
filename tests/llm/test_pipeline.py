"""The pipeline as a chain against plain Python: whatever the network accepts is followed by hand."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import sentencepiece

import corpus_pipeline
from lakewarden.llm.queries import PIECES, tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows():
    chosen = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "Su", "te") for b in ("ra", "vin", "dok", "s", "mel")]

    def prose(n):
        return " ".join(chosen.choice(vocabulary) for _ in range(n))

    passage, texts = prose(70), []
    texts += [prose(chosen.randrange(60, 150)) for _ in range(12)]
    for i in range(4):  # near copies in a chain, and exact ones
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        words[-1] = "end"
        texts += [" ".join(words), texts[i]]
    texts += [f"{prose(20 + 9 * i)}\n{passage}  {prose(5 + 40 * i)}" for i in range(6)]
    texts += [passage, None, "", "one two", prose(800)]
    texts += ["!! XX ## $$ " * 20] * 3
    chosen.shuffle(texts)
    sources = ["web", "books", "é", None]
    return [(i * 3 + 1, t, "en", sources[i % 4]) for i, t in enumerate(texts)]


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_near_copies(docs):
    component = {i: i for i in docs}
    sets = {i: shingles(t) for i, (t, _) in docs.items()}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    return {i: d for i, d in docs.items() if root(i) == i}


def without_passages(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        text, source = docs[i]
        words = WORDS.findall(text or "")
        windows = [tuple(words[p:p + 50]) for p in range(len(words) - 49)]
        gone = {q for p, w in enumerate(windows) if w in seen for q in range(p, p + 50)}
        seen.update(windows)
        out[i] = (" ".join(w for p, w in enumerate(words) if p not in gone) if gone else text, source)
    return out


def targets(sizes):
    """Exact targets by source: weights 5, 2, 1 in turn, none above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    found, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * share > 3 * sizes[s]}
        if not full:
            return found | {s: weights[s] * share for s in open_}
        for s in full:
            found[s] = Fraction(3 * sizes[s])
            rest -= found[s]
        open_ -= full
    return found


def test_the_chain_equals_plain_python(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn(
        "n_chars", corpus_pipeline.F.length("text").cast("bigint")).write.parquet(
            str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(not (r[1] or "").startswith("!!"))) for r in rows],
                          "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r["doc_id"] for r in corpus_pipeline.quality(spark, documents, str(tmp_path)).collect()}
    given = {r[0]: (r[1], r[3]) for r in rows if r[0] in accepted}
    single = without_near_copies(given)
    cleaned = without_passages(single)
    assert len(given) > len(single) and any(cleaned[i] != single[i] for i in single)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r["doc_id"] for r in found)
    size = {i: len(WORDS.findall(t or "")) for i, (t, _) in cleaned.items()}
    assert set(times) <= {i for i in cleaned if size[i]} and max(times.values()) <= 3
    of_source, taken = defaultdict(int), defaultdict(int)
    for i, (_, source) in cleaned.items():
        of_source[source] += size[i]
        taken[source] += size[i] * times[i]
    for source, target in targets(of_source).items():
        # All documents as often as they fit, then once more those whose sum is nearest to the rest.
        passes = int(target // of_source[source])
        sums = {passes * of_source[source]}
        for i, (_, s) in cleaned.items():
            if s == source and size[i]:
                assert times[i] - passes in (0, 1)
                sums |= {x + size[i] for x in sums}
        assert abs(taken[source] - target) < min(abs(x - target) for x in sums) + 1, source

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    for r in found:
        ids = library.encode(cleaned[r["doc_id"]][0], add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(raw).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())
