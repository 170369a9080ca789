"""Phrases against plain Python, and the quotient filters they are counted in."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lakewarden.llm import quotient_filter as qf
from lakewarden.llm.phrases import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id bigint, text string, lang string, n bigint, word string, id bigint"


def brute_force(rows, least=10, cover=50, top=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, words), a in candidates.items():
        for part in ([words[:2], words[1:]] if len(words) == 3 else []):
            longer[lang, part] = max(longer[lang, part], a)
    for (lang, words), a in candidates.items():
        if longer[lang, words] and 100 * longer[lang, words] >= cover * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    found = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(r[0], i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(found)


def _rows(n, seed=1):
    chosen = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "É", "日本", "x", "of", "the", "don't"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " ", " "]
    rows = []
    for _ in range(n):
        text = "".join(chosen.choice(words) + chosen.choice(marks) for _ in range(chosen.randrange(40)))
        rows.append((text + chosen.choice(["", " new york city", " red  Tape!", "\x0b of the"]),
                     chosen.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 500, "fan": 3, "shard_entries": 64},
                                      {"top": 5, "least": 2, "cover": 80}])
def test_equals_brute_force(spark, work, settings):
    rows = _rows(300) + [(None, "en"), ("", None), ("y" * 20_000, "en"), ("a b " * 5000, "fr"), ("\xa0 \x1c", "en")]
    docs = spark.createDataFrame([(i % 9, t, la, 1, "w", 2) for i, (t, la) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in phrases(docs, work, **settings).select(*COLUMNS).collect())
    plain = {k: v for k, v in settings.items() if k in ("top", "least", "cover")}
    assert got == brute_force(rows, **plain) and got


def test_no_phrases(spark, work):
    docs = spark.createDataFrame([(1, "only once", "en", 1, "w", 2)], SCHEMA)
    assert phrases(docs, work + "a").collect() == []
    assert phrases(docs.where("false"), work + "b").collect() == []


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("id_bits", [8, 11, 12, 16, 21, 22, 31, 32])
def test_numbers_come_back(n, id_bits):
    layout = qf.Layout(n, id_bits)
    ids = np.random.default_rng(id_bits).integers(0, 1 << id_bits, (2000, n))
    ids[0], ids[1] = 0, (1 << id_bits) - 1
    high, low = layout.packed(ids)
    assert (layout.unpacked(high, low) == ids).all()
    assert int(high.max()) < 1 << layout.high_bits and int(low.max()) < 1 << layout.low_bits
    assert len(set(zip(high.tolist(), low.tolist()))) == len({tuple(i) for i in ids.tolist()})


@pytest.mark.parametrize("id_bits, shard_bits", [(8, 0), (8, 3), (17, 5), (32, 9)])
def test_filters_merge_without_loss(id_bits, shard_bits):
    layout = qf.Layout(3, id_bits)
    chosen = np.random.default_rng(7)
    whole = Counter()
    by_shard: dict = {}
    for _ in range(4):
        ids = chosen.integers(0, min(1 << id_bits, 30), (3000, 3))
        whole.update(map(tuple, ids.tolist()))
        for shard, blob in qf.split(layout, shard_bits, *qf.distinct(layout, *layout.packed(ids))):
            by_shard.setdefault(shard, []).append(blob)
    got = Counter()
    for shard, blobs in by_shard.items():
        high, low, counts = qf.merged(layout, shard_bits, shard, blobs)
        again = qf.from_filter(layout, shard_bits, shard, qf.to_filter(layout, shard_bits, high, low, counts))
        assert all((a == b).all() for a, b in zip(again, (high, low, counts), strict=True))
        for gram, count in zip(layout.unpacked(high, low).tolist(), counts.tolist(), strict=True):
            got[tuple(gram)] += count
    assert got == whole


def test_filters_are_compact():
    layout = qf.Layout(3, 20)
    ids = np.random.default_rng(1).integers(0, 1 << 20, (50_000, 3))
    numbers = qf.distinct(layout, *layout.packed(ids))
    assert len(qf.to_filter(layout, 0, *numbers)) < 8 * len(numbers[0])
