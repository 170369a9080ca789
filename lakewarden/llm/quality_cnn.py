"""Quality: a convolutional network over bytes, in numpy.

A document is cut into chunks of CHUNK bytes, each overlapping the next by OVERLAP, down to its last
byte. Every byte has a learned vector; FILTERS learned filters of WIDTH bytes pass over a chunk
byte by byte, and each keeps its largest response (max-pooling). A hidden layer turns these
into HIDDEN values per chunk; their mean and maximum over all chunks of the document go into one
logistic unit. All parts are fitted together by gradient steps (Adam).

The fit reads at most SAMPLE texts of each label, drawn until they have `sampling.SAMPLE_BYTES`; fit
and scoring read every byte of a text. Both labels weigh the same, and the score is set back to their
share among all labelled rows. The model is a few kilobytes.

Defined results: a null or empty text is one chunk of padding. Without labels of both kinds every
score is the share of label 1 (1 if there are no labels: nothing speaks against the texts). Rows
that share an id are each scored. `rejected` drops rows by score and keeps all columns, also those
of clashing names. Empty tables give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.sampling import fitted_model, labelled_sample
from lakewarden.llm.text import rows_of, texts_of

SAMPLE = 2500  # texts of each label that the fit reads
CHUNK = 512
OVERLAP = 64
WIDTH = 8
VECTOR = 4
FILTERS = 32
HIDDEN = 16
EPOCHS = 20
THRESHOLD = 0.3
AT_ONCE = 256  # chunks in one matrix product

Model = dict[str, np.ndarray]


def chunks(text: bytes) -> np.ndarray:
    """The overlapping chunks of a text, padded with zero bytes; at least one."""
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(text) - CHUNK) // step))
    padded = np.zeros((n - 1) * step + CHUNK, dtype=np.uint8)
    padded[:len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _start(seed: int = 3) -> Model:
    random = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return random.normal(0, scale, shape).astype(np.float32)

    return {"bytes": normal(256, VECTOR, scale=0.5),
            "filters": normal(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5),
            "filter_bias": np.zeros(FILTERS, dtype=np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=FILTERS ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, dtype=np.float32),
            "last": normal(2 * HIDDEN, scale=0.1), "last_bias": np.zeros(1, dtype=np.float32),
            "offset": np.zeros(1, dtype=np.float32)}


def _pooled(model: Model, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every chunk, and where it was."""
    most, where = [], []
    for i in range(0, len(block), AT_ONCE):
        part = block[i:i + AT_ONCE]
        vectors = model["bytes"][part].reshape(len(part), CHUNK * VECTOR)
        windows = np.lib.stride_tricks.sliding_window_view(
            vectors, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        places = windows.shape[1]
        responses = (windows.reshape(-1, WIDTH * VECTOR) @ model["filters"]).reshape(
            len(part), places, FILTERS)
        at = responses.argmax(axis=1)
        most.append(np.take_along_axis(responses, at[:, None], axis=1)[:, 0])
        where.append(at)
    return np.concatenate(most) + model["filter_bias"], np.concatenate(where)


def _pooled_values(model: Model, block: np.ndarray) -> np.ndarray:
    """As `_pooled`, without the places, which only the fit needs."""
    most = []
    for i in range(0, len(block), AT_ONCE):
        part = block[i:i + AT_ONCE]
        vectors = model["bytes"][part].reshape(len(part), CHUNK * VECTOR)
        windows = np.lib.stride_tricks.sliding_window_view(
            vectors, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        responses = windows.reshape(-1, WIDTH * VECTOR) @ model["filters"]
        most.append(responses.reshape(len(part), -1, FILTERS).max(axis=1))
    return np.concatenate(most) + model["filter_bias"]


def _combined(model: Model, pooled: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log odds per document from the pooled responses of its chunks; `begin`: its first chunk."""
    active = np.maximum(pooled, 0)
    hidden = np.maximum(active @ model["hidden"] + model["hidden_bias"], 0)
    counts = np.diff(np.append(begin, len(pooled)))[:, None].astype(np.float32)
    mean = np.add.reduceat(hidden, begin, axis=0) / counts
    most = np.maximum.reduceat(hidden, begin, axis=0)
    z = np.hstack([mean, most]) @ model["last"] + model["last_bias"][0]
    return z, active, hidden, mean, most, counts


def _gradients(model: Model, block: np.ndarray, begin: np.ndarray, y: np.ndarray,
               weight: np.ndarray | float = 1.0) -> Model:
    pooled, where = _pooled(model, block)
    z, active, hidden, mean, most, counts = _combined(model, pooled, begin)
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
    owner = np.repeat(np.arange(len(begin)), counts[:, 0].astype(int))
    to_hidden = np.outer(error, model["last"][:HIDDEN]) / counts
    to_hidden = to_hidden[owner] + (hidden == most[owner]) * np.outer(
        error, model["last"][HIDDEN:])[owner]
    to_hidden = to_hidden * (hidden > 0)
    to_pooled = (to_hidden @ model["hidden"].T) * (pooled > 0)
    filters = np.zeros((WIDTH, VECTOR, FILTERS))
    to_vectors = np.zeros((256, VECTOR))
    shaped = model["filters"].reshape(WIDTH, VECTOR, FILTERS)
    for i in range(0, len(block), AT_ONCE):  # a long text has many chunks
        at = slice(i, i + AT_ONCE)
        spots = where[at, :, None] + np.arange(WIDTH)
        read = np.take_along_axis(block[at, None, :], spots, axis=2)  # chunk, filter, byte of window
        filters += np.einsum("nf,nfwv->wvf", to_pooled[at], model["bytes"][read], optimize=True)
        to_bytes = np.einsum("nf,wvf->nfwv", to_pooled[at], shaped, optimize=True)
        to_bytes = to_bytes.reshape(-1, VECTOR)
        to_vectors += np.stack([np.bincount(read.ravel(), weights=to_bytes[:, v], minlength=256)
                                for v in range(VECTOR)], axis=1)
    return {"bytes": to_vectors, "filters": filters.reshape(-1, FILTERS),
            "filter_bias": to_pooled.sum(axis=0), "hidden": active.T @ to_hidden,
            "hidden_bias": to_hidden.sum(axis=0),
            "last": np.concatenate([error @ mean, error @ most]),
            "last_bias": np.array([error.sum()])}


def fit(texts: list[bytes], labels: list[int], share: float = 0.5, epochs: int = EPOCHS,
        group: int = 50, rate: float = 0.004) -> bytes:
    """The fitted model as bytes."""
    model = _start()
    random = np.random.default_rng(11)
    if 0 < share < 1:
        model["offset"][0] = np.log(share / (1 - share))
    y = np.array(labels, dtype=np.float32)
    if len(y) and y.min() < y.max():
        # Both labels weigh the same, however many texts of each there are.
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        parts = [chunks(text) for text in texts]
        first = {k: np.zeros_like(v) for k, v in model.items()}
        second = {k: np.zeros_like(v) for k, v in model.items()}
        step = 0
        for epoch in range(epochs):
            order = random.permutation(len(parts))
            pace = rate * (1 - epoch / epochs) + rate / 20
            for i in range(0, len(order), group):
                chosen = order[i:i + group]
                block = np.concatenate([parts[j] for j in chosen])
                begin = np.cumsum([0, *(len(parts[j]) for j in chosen)])[:-1]
                step += 1
                for name, g in _gradients(model, block, begin, y[chosen], weight[chosen]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    scale = np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8
                    model[name] -= (pace * first[name] / (1 - 0.9 ** step) / scale).astype(
                        np.float32)
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def opened(model: bytes) -> Model:
    with np.load(io.BytesIO(model)) as stored:
        return {name: stored[name] for name in stored.files}


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of label 1 of each text, over all its bytes."""
    z, group, begin, held = [], [], [], 0

    def flush() -> None:
        nonlocal group, begin, held
        if group:
            pooled = np.concatenate([_pooled_values(model, block) for block in group])
            z.append(_combined(model, pooled, np.array(begin))[0])
        group, begin, held = [], [], 0

    small: list[np.ndarray] = []
    for text in texts:
        cut = chunks(text)
        begin.append(held)
        held += len(cut)
        if len(cut) >= AT_ONCE:
            if small:
                group.append(np.concatenate(small))
                small = []
            group.append(cut)
        else:
            small.append(cut)
        if held >= 2 * AT_ONCE:
            if small:
                group.append(np.concatenate(small))
                small = []
            flush()
    if small:
        group.append(np.concatenate(small))
    flush()
    total = np.concatenate(z) if z else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(total + model["offset"][0], -30, 30).astype(np.float64)))


def _model(docs: DataFrame, labels: DataFrame, learn: Column, work: str,
           per_class: int) -> bytes:
    sample, counts = labelled_sample(docs, labels, "quality", learn, per_class, work)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if 0 < share < 1:
        return fitted_model(sample, fit, share=share)
    constant = _start()
    constant["last"][:] = 0
    constant["offset"][0] = 30 if share else -30
    out = io.BytesIO()
    np.savez(out, **constant)
    return out.getvalue()


def _scored(docs: DataFrame, labels: DataFrame, learn: Column, work: str, per_class: int,
            kept: list[Column], with_text: bool) -> DataFrame:
    """doc_id, score, predicted, kept_0, ..., and with_text the text as bytes."""
    model = _model(docs, labels, learn, work, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    given = texts_of(docs, *[c.alias(f"kept_{i}") for i, c in enumerate(kept)])
    passed = [c for c in given.columns if c != "doc_id" and (with_text or c != "text")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = opened(shared.value)
        for batch in batches:
            found = [scores(texts, network) for _, texts in rows_of([batch])]
            values = pa.array(np.concatenate(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), values, *[batch.column(c) for c in passed]],
                ["doc_id", "score", *passed])

    schema = ["doc_id bigint", "score double",
              *[f"{c} {given.schema[c].dataType.simpleString()}" for c in passed]]
    return given.mapInArrow(run, ", ".join(schema)).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, work: str, *,
           per_class: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted. `learn` selects labels by doc_id; `work` is a fresh shared folder."""
    return _scored(docs, labels, learn, work, per_class, [], False)


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, work: str, *,
             per_class: int = SAMPLE) -> DataFrame:
    """The documents that the network does not reject, with all their columns."""
    others = [c for c in docs.columns if c != "text"]
    kept = [F.col("text").isNull(), *[F.col(f"`{c}`") for c in others]]
    found = _scored(docs, labels, learn, work, per_class, kept, True).where("predicted = 1")
    back = {c: F.col(f"kept_{i}") for i, c in enumerate(others, start=1)}
    back["text"] = F.when(~F.col("kept_0"), F.col("text").cast("string"))
    return found.select(*[back[c].alias(c) for c in docs.columns])
