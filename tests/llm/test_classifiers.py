"""Held-out accuracy on the given tables, and results for odd input."""

from pathlib import Path

import numpy as np
import pytest

from lakewarden.llm import quality_cnn, toxicity
from lakewarden.llm.sampling import labelled_sample
from lakewarden.llm.text import crc32_mod

FOLDER = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


@pytest.mark.parametrize("module, label, modulus, rest, good", [
    (toxicity, "toxic", 4, 2, 0.95), (quality_cnn, "quality", 5, 0, 0.95)])
@given
def test_held_out_accuracy(spark, work, module, label, modulus, rest, good):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = module.scored(docs, labels, crc32_mod("doc_id", modulus) != rest, work)
    rows = found.join(labels.where(crc32_mod("doc_id", modulus) == rest), "doc_id").select(
        label, "predicted", "score").collect()
    assert len(rows) > 500 and all(0 <= r["score"] <= 1 for r in rows)
    rare = 1 if label == "toxic" else 0  # a few hundred texts to learn from here
    for value in (0, 1):
        own = [r["predicted"] == value for r in rows if r[label] == value]
        assert np.mean(own) > (0.8 if value == rare else good)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_cnn, "quality")])
def test_odd_input(spark, make_docs, odd_texts, work, module, label):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "x"), (3, "again"), (3, "again")]
    docs = make_docs(rows)
    schema = f"doc_id bigint, {label} int, text string"
    every = crc32_mod("doc_id", 2) >= 0
    labels = spark.createDataFrame(
        [(i, i % 2, "x") for i in range(9)] + [(None, 1, "x"), (5, None, "x"), (77, 1, "x"),
                                               (3, 1, "x")], schema)
    found = module.scored(docs, labels, every, work).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([], schema)
    scores = {r["score"] for r in module.scored(docs, none, every, work + "-none").collect()}
    assert len(scores - {0.0}) <= 1
    assert module.scored(make_docs([]), labels, every, work + "-empty").collect() == []


def test_misspelt_words_share_vectors():
    clean = [f"the {w} of a plain text here".encode() for w in ("word", "line", "end", "sum")] * 20
    rude = [b"the blockhead of a plain text here", b"a plain text blockhead"] * 40
    model = np.frombuffer(toxicity.fit(clean + rude, [0] * len(clean) + [1] * len(rude)),
                          dtype=np.float32)
    a, b, c = toxicity.scores([b"of a blokhead", b"of a table", b""], model)
    assert a > 0.5 > b and c == 0


def test_network_reads_every_byte():
    cut = quality_cnn.chunks(bytes(range(1, 251)) * 8)
    step = quality_cnn.CHUNK - quality_cnn.OVERLAP
    joined = bytes(cut[0]) + b"".join(bytes(c[-step:]) for c in cut[1:])
    assert joined.rstrip(b"\0") == bytes(range(1, 251)) * 8
    model = quality_cnn.opened(quality_cnn.fit([b"a " * 50, b"b " * 50] * 20, [0, 1] * 20, epochs=3))
    texts = [b"a " * n for n in (0, 1, 300, 700, 200_000)]
    together = quality_cnn.scores(texts, model)
    assert np.allclose(together, [quality_cnn.scores([t], model)[0] for t in texts], atol=1e-5)


def test_pooled_gradients_follow_the_loss():
    random = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in quality_cnn._start().items()}
    block = random.integers(0, 256, (3, quality_cnn.CHUNK)).astype(np.uint8)
    begin, y = np.array([0, 2]), np.array([1.0, 0.0])

    def loss():
        z = quality_cnn._combined(model, quality_cnn._pooled(model, block)[0], begin)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = quality_cnn._gradients(model, block, begin, y)
    for name, at in (("filters", (3, 5)), ("hidden", (4, 2)), ("last", (1,)), ("bytes", (65, 1))):
        step = 1e-5
        model[name][at] += step
        up = loss()
        model[name][at] -= 2 * step
        down = loss()
        model[name][at] += step
        assert found[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-6)


def test_rejected_documents_go_with_their_columns_kept(spark, make_docs, work):
    rows = [(i, "good words in plain order here " * 3 if i % 2 else "!! !! XX " * 9)
            for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    docs = make_docs(rows)
    found = quality_cnn.accepted(docs, labels, crc32_mod("doc_id", 2) >= 0, work)
    assert found.columns == docs.columns
    assert {r["doc_id"] for r in found.collect()} >= {i for i in range(60) if i % 2}


def test_a_pattern_is_seen_at_any_byte():
    model = quality_cnn._start()
    pattern = np.frombuffer(b"odd\xc3\xa9byt", dtype=np.uint8)
    model["filters"][:, 0] = model["bytes"][pattern].ravel()  # its largest response to the pattern
    full = float((model["filters"][:, 0] ** 2).sum())
    for at in (0, 1, 10, 11, 447, 448, 449, 503, 504):
        text = b" " * at + pattern.tobytes() + b" " * (1200 - at)
        block = quality_cnn.chunks(text)
        most, where = quality_cnn._pooled(model, block)
        assert np.array_equal(most, quality_cnn._pooled_values(model, block))
        assert np.isclose(most[:, 0].max(), full, rtol=1e-5)
        assert where[0, 0] == at


def test_the_fit_reads_a_long_text_to_its_last_byte():
    random = np.random.default_rng(5)

    def text(end: bytes, blanks: int) -> bytes:
        return b"plain words in order " * (blanks // 21) + end

    lengths = random.integers(9_000, 20_000, 80)  # 20 to 45 chunks; only the end tells
    texts = [text(b"#$%& #$%& #$%&" if i % 2 else b"plain words.", n) for i, n in enumerate(lengths)]
    model = quality_cnn.opened(quality_cnn.fit(texts, [1 - i % 2 for i in range(80)], epochs=80))
    found = quality_cnn.scores([text(b"#$%& #$%& #$%&", 30_000), text(b"plain words.", 30_000)], model)
    assert found[0] < 0.3 < 0.7 < found[1]


def _naive_network(text: bytes, m) -> float:
    """The score of a text, one response at a time."""
    step, width, size = 448, 8, 512
    hidden = []
    for c in range(1 + max(0, -(-(len(text) - size) // step))):
        chunk = text[c * step:c * step + size].ljust(size, b"\0")
        pooled = [max(sum(float(m["bytes"][chunk[p + w]][v]) * float(m["filters"][w * 4 + v][f])
                          for w in range(width) for v in range(4))
                      for p in range(size - width + 1)) + float(m["filter_bias"][f])
                  for f in range(m["filters"].shape[1])]
        hidden.append([max(0.0, sum(max(0.0, x) * float(m["hidden"][f][h])
                                    for f, x in enumerate(pooled)) + float(m["hidden_bias"][h]))
                       for h in range(m["hidden"].shape[1])])
    columns = list(zip(*hidden, strict=True))
    inputs = [sum(c) / len(c) for c in columns] + [max(c) for c in columns]
    z = sum(x * float(w) for x, w in zip(inputs, m["last"], strict=True))
    return float(1 / (1 + np.exp(-(z + float(m["last_bias"][0]) + float(m["offset"][0])))))


def test_scores_equal_a_naive_convolution(monkeypatch):
    model = {k: v.copy() for k, v in quality_cnn._start(9).items()}
    model["filters"], model["filter_bias"] = model["filters"][:, :3], model["filter_bias"][:3]
    model["hidden"] = model["hidden"][:3]
    model["last_bias"][0], model["offset"][0] = 0.2, -0.4
    monkeypatch.setattr(quality_cnn, "FILTERS", 3)
    texts = [b"", b"a", "naïve text ".encode() * 30, bytes(range(256)) * 4]
    assert np.allclose(quality_cnn.scores(texts, model),
                       [_naive_network(t, model) for t in texts], atol=1e-4)


def test_samples_are_bounded_in_rows_and_bytes(spark, make_docs, work):
    docs = make_docs([(i % 50, "x" * 100) for i in range(400)] + [(60, "y" * 5000)])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(61)],
                                   "doc_id bigint, quality int")
    every = crc32_mod("doc_id", 2) >= 0
    found, counts = labelled_sample(docs, labels, "quality", every, 20, work, 1000)
    by_label = {c: [len(r["text"]) for r in found.where(f"label = {c}").collect()] for c in (0, 1)}
    assert counts == {0: 31, 1: 30}
    assert all(0 < sum(n) - max(n) < 1000 for n in by_label.values()) and sum(by_label[1]) == 1000
    few, _ = labelled_sample(docs, labels, "quality", every, 7, work + "-few")
    assert {r["n"] for r in few.groupBy("label").count().toDF("label", "n").collect()} == {7}


def _naive_toxicity(text: bytes, values, offset: float) -> float:
    """The most toxic six words of a text, n-gram by n-gram."""
    words = text.lower().split()
    if not words:
        return 0.0
    factors = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]
    grams = []
    for word in words:
        spaced, own = b" " + word + b" ", []
        for n in (3, 4, 5):
            for p in range(len(spaced) - n + 1):
                h = sum(spaced[p + k] * factors[k] for k in range(n)) % 2**32
                own.append(float(values[(h ^ (h >> 15)) * (0x2C1B3C6D + 2 * n) % 2**32 >> 16]))
        grams.append(own)
    windows = [sum(grams[i:i + 6], []) for i in range(max(1, len(words) - 5))]
    return float(1 / (1 + np.exp(-(max(sum(w) / len(w) for w in windows) + offset))))


def test_toxicity_scores_equal_naive_windows():
    random = np.random.default_rng(6)
    model = random.normal(0, 2, toxicity.BUCKETS + 1).astype(np.float32)
    letters = "a b c Z é 日 . ! x1 LONGER word".split(" ")
    texts = ["", " \t ", "a", "Ab c", "one two three four five six", "one two three four five six seven"]
    texts += [" ".join("".join(random.choice(letters, random.integers(1, 5)))
                       for _ in range(random.integers(1, 40))) for _ in range(30)]
    texts = [t.encode() for t in texts]
    naive = [_naive_toxicity(t, model[:-1], float(model[-1])) for t in texts]
    assert np.allclose(toxicity.scores(texts, model), naive, atol=1e-9)
