"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's subwords are its character n-grams (3 to 5 bytes, letters A-Z lower-cased, a blank before
and after the word included), hashed into BUCKETS vectors. The vectors of all subwords of WINDOW
consecutive words are averaged and go through a linear layer and a softmax over two classes. A text
is scored by its most toxic window, so one insult in a long text is not averaged away; a text with
fewer words is one window. A misspelt insult shares most n-grams, and so vectors, with the word.

Vectors and layer are fitted together by gradient steps: first on the average of the whole text,
then on the most toxic window. At most SAMPLE texts of each label are used, drawn whole until they
have `sampling.SAMPLE_BYTES`; the sample is balanced and the score is set back to the share of the labels among all labelled rows.

As the layer is linear, a subword adds one number to a window, so scoring takes a table of BUCKETS
numbers: the model that travels to executors is 4 * BUCKETS bytes.

Defined results: a null or empty text has nothing to judge and scores 0. Without labels of both kinds every score is the share of label 1 (0 if there are none).
Rows that share an id are each scored. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.sampling import fitted_model, labelled_sample
from lakewarden.llm.text import IS_BLANK, rows_of, texts_of

SAMPLE = 1500  # texts of each label that the fit reads
BUCKETS = 1 << 16
SIZES = (3, 4, 5)
WINDOW = 6
DIM = 8
RATE = 100.0  # of the subword vectors, each of which gets a small share of the gradient
STEPS = 110  # at most
WHOLE_STEPS = 20  # on whole texts, before windows
ENOUGH = 0.005  # mean error at which the fit ends
THRESHOLD = 0.3
PIECE = 1 << 20  # bytes scored at a time

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[IS_BLANK] = 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1],
                        dtype=np.uint32)


class Subwords:
    """Hashed n-grams of some texts joined by blanks, word by word."""

    def __init__(self, texts: list[bytes]):
        joined = b" " + b" ".join(texts) + b" "
        data = _FOLDED[np.frombuffer(joined, dtype=np.uint8)]
        inside = data != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, ends = edges[0::2], edges[1::2] + 2  # with a blank on either side
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(self.starts, offsets - 1)
        self.words_before = first  # index of each text's first word
        wide = data.astype(np.uint32)
        self.buckets, self.edges = [], []
        for n in SIZES:
            hashed = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
            with np.errstate(over="ignore"):
                for k in range(n):
                    hashed += wide[k:k + len(hashed)] * _MULTIPLIERS[k]
                hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            self.buckets.append((hashed >> np.uint32(16)).astype(np.uint16))
            # n-grams of word i begin from starts[i] up to its last n bytes.
            self.edges.append((self.starts, np.maximum(ends - n + 1, self.starts)))
        self.counts = sum(b - a for a, b in self.edges)

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of `values` by bucket over the n-grams of each word."""
        total = np.zeros(len(self.starts))
        for buckets, (a, b) in zip(self.buckets, self.edges, strict=True):
            sums = np.empty(len(buckets) + 1)
            sums[0] = 0
            np.cumsum(values[buckets], out=sums[1:])
            total += sums[np.minimum(b, len(buckets))] - sums[np.minimum(a, len(buckets))]
        return total

    def window_means(self, values: np.ndarray, width: int | None = WINDOW
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: largest mean over windows of `width` words, and the words of that window."""
        texts = len(self.words_before) - 1
        sums = np.concatenate([[0.0], np.cumsum(self.word_sums(values))])
        counts = np.concatenate([[0], np.cumsum(self.counts)])
        lo, hi = self.words_before[:-1], self.words_before[1:]
        if width is None:
            a, b = lo, hi
            mean = (sums[b] - sums[a]) / np.maximum(counts[b] - counts[a], 1)
            return mean, a, b
        starts = np.arange(len(self.starts))
        text = np.repeat(np.arange(texts), hi - lo)
        # A window begins at every word that leaves a whole window, or at the text's first word.
        keep = (starts + width <= hi[text]) | (starts == lo[text])
        starts, text = starts[keep], text[keep]
        ends = np.minimum(starts + width, hi[text])
        mean = (sums[ends] - sums[starts]) / np.maximum(counts[ends] - counts[starts], 1)
        best, a, b = np.zeros(texts), lo.copy(), lo.copy()
        if len(mean):
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            most = np.maximum.reduceat(mean, begin)
            owners = text[begin]
            best[owners] = most
            group = np.cumsum(np.concatenate([[False], text[1:] != text[:-1]]))
            hits = np.flatnonzero(mean == most[group])
            firsts = hits[np.unique(group[hits], return_index=True)[1]]
            a[owners], b[owners] = starts[firsts], ends[firsts]
        return best, a, b

    def spread(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum per bucket of `weight` over the n-grams of words a to b of each text."""
        out = np.zeros(BUCKETS)
        words = np.repeat(weight, b - a)
        at = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]
                            or [np.empty(0, dtype=np.int64)]).astype(np.int64)
        for buckets, (start, end) in zip(self.buckets, self.edges, strict=True):
            n = (end - start)[at]
            skip = np.repeat(start[at] - (np.cumsum(n) - n), n)
            grams = np.arange(n.sum()) + skip
            out += np.bincount(buckets[grams], weights=np.repeat(words, n), minlength=BUCKETS)
        return out


def fit(texts: list[bytes], labels: list[int], share: float = 0.5, steps: int = STEPS) -> bytes:
    """The table of subword values, and the offset, as bytes. Both labels weigh the same."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS + 1, dtype=np.float32).tobytes()
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    bags = Subwords(texts)
    random = np.random.default_rng(5)
    vectors = random.normal(0, 0.1, (BUCKETS, DIM))
    layer = random.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    seen = bags.spread(bags.words_before[:-1], bags.words_before[1:], np.ones(len(y))) > 0
    vectors[~seen] = 0
    slow = np.zeros_like(vectors), np.zeros_like(layer), np.zeros(2)
    for step in range(steps):
        whole = step < WHOLE_STEPS
        values = vectors @ (layer[1] - layer[0])
        mean, a, b = bags.window_means(values, None if whole else WINDOW)
        z = mean + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if not whole and (weight * np.abs(p - y)).sum() < ENOUGH:
            break
        error = (p - y) * weight  # the gradient of class 1; that of class 0 is its negative
        counts = np.concatenate([[0], np.cumsum(bags.counts)])
        per_bucket = bags.spread(a, b, error / np.maximum(counts[b] - counts[a], 1))
        to_layer = per_bucket @ vectors
        gradients = (np.outer(per_bucket, layer[1] - layer[0]), np.stack([-to_layer, to_layer]),
                     np.array([-error.sum(), error.sum()]))
        for state, parameter, gradient, rate in zip(
                slow, (vectors, layer, bias), gradients, (RATE, 0.5, 0.5), strict=True):
            state *= 0.9
            state += gradient
            parameter -= rate * state
    prior = np.log(share / (1 - share)) if 0 < share < 1 else 0.0
    values = vectors @ (layer[1] - layer[0])
    return np.append(values, bias[1] - bias[0] + prior).astype(np.float32).tobytes()


def scores(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text."""
    values, offset = model[:-1].astype(np.float64), float(model[-1])
    out, group, size = [], [], 0
    for text in (*texts, None):
        if group and (text is None or size + len(text) > PIECE):
            bags = Subwords(group)
            z = bags.window_means(values)[0] + offset
            out.append(np.where(np.diff(bags.words_before) > 0, z, -np.inf))
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)
    z = np.concatenate(out) if out else np.empty(0)
    return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, work: str, *,
           per_class: int = SAMPLE) -> DataFrame:
    """doc_id and score. `learn` selects labels by doc_id; `work` is a fresh shared folder."""
    sample, counts = labelled_sample(docs, labels, "toxic", learn, per_class, work)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if 0 < share < 1:
        model = fitted_model(sample, fit, share=share)
    else:
        model = np.append(np.zeros(BUCKETS), 30 if share else -30).astype(np.float32).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * (BUCKETS + 1) bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.float32)
        for batch in batches:
            for ids, texts in rows_of([batch]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(scores(texts, table), pa.float64())],
                    ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
