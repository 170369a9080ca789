"""Words, hashes and batches of documents, shared by the operators of this subpackage.

A word is a maximal run of bytes other than the six ASCII blanks (space and 0x09 to 0x0D); UTF-8
keeps those bytes out of longer characters, and `bytes.split()` cuts at exactly these six.

Hashes of words and of word windows are 128 bits in two independent halves, computed for many documents
at once with numpy. A word's halves are sums of random values, one for each of its bytes and their
places; words of more than LONG_WORD bytes go through blake2b. Windows fold the hashes of their words
pairwise with steps that are not linear, so no pattern of bytes or words makes two of them meet. Two
different words or windows share both halves with a probability of about 2**-128.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\v\f\r"
IS_BLANK = np.isin(np.arange(256), list(BLANKS))
_BLANK = re.compile(rb"[ \t-\r]")
SEGMENT = 1 << 20  # bytes hashed at a time; a longer word is hashed whole

LONG_WORD = 64
_FOLDS = ((0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (0x9FB21C651E98DF25, 0xE7037ED1A0B428DB))

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one for a given seed)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _letter_values(which: int) -> np.ndarray:
    """A random value for each place (up to LONG_WORD) and byte."""
    return mix(mix(np.arange(LONG_WORD << 8, dtype=np.uint64), 50 + which), 60 + which)


def _segment_words(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes (two rows) of the words of one piece of text."""
    data = np.frombuffer(segment, dtype=np.uint8)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_BLANK[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, np.empty((2, 0), dtype=np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    at = (np.minimum(place, LONG_WORD - 1) << 8) | data[inside[1:-1]]
    hashes = np.empty((2, len(starts)), dtype=np.uint64)
    for which in range(2):
        hashes[which] = np.add.reduceat(_letter_values(which)[at], first)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = blake2b(segment[starts[i]:ends[i]], digest_size=16).digest()
        hashes[:, i] = np.frombuffer(digest, dtype="<u8")
    return starts, hashes


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order (a row for each half), and how many each text has."""
    counts = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    group: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal size
        if group:
            starts, hashes = _segment_words(b" ".join(group))
            offsets = np.cumsum([0, *(len(t) + 1 for t in group)])
            counts[first:upto] += np.diff(np.searchsorted(starts, offsets))
            found.append(hashes)
            group.clear()
        size = 0

    for i, text in enumerate(texts):
        if size and size + len(text) > SEGMENT:
            flush(i)
        if not group:
            first = i
        if len(text) <= SEGMENT:
            group.append(text)
            size += len(text) + 1
            continue
        position = 0
        while position < len(text):  # a long text is cut at blanks
            cut = _BLANK.search(text, min(position + SEGMENT, len(text)))
            end = cut.start() if cut else len(text)
            _, hashes = _segment_words(text[position:end])
            counts[i] += hashes.shape[1]
            found.append(hashes)
            position = end
    flush(len(texts))
    return (np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.uint64)), counts


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of `width` values, by doubling; empty if there are fewer.

    `which`: one of two independent functions.
    """
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    left, right = (np.uint64(f) for f in _FOLDS[which])

    def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * left
        return (x ^ (x >> np.uint64(29))) + y * right

    out, done = None, 0
    power, span = mix(words, 1 + which), 1
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                if out is None:
                    out = power[: len(words) - width + 1 if width == span else None]
                else:
                    n = min(len(out), len(power) - done)
                    out = fold(out[:n], power[done:done + n])
                done += span
            if done == width:
                return mix(out[: len(words) - width + 1])
            n = len(power) - span
            power = fold(power[:n], power[span:])
            span *= 2


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of values, ascending and each once: firsts, seconds, where each is met first, and for
    each given pair its place among them."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & other).any():  # one first half with several second ones
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~same | other
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], b[new], order[new], back


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window lies within one text, and the index of that text."""
    whole = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), whole)
    before = np.cumsum(counts) - counts
    shift = before - (np.cumsum(whole) - whole)
    return np.arange(whole.sum()) + shift[text], text


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of `starts`."""
    change = np.bincount(starts, minlength=n + 1)[:n + 1]
    change -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[:n + 1]
    return np.cumsum(change[:n]) > 0


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the whole text as bytes (null: empty), and columns asked for; nothing else."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *more)


def rows_of(batches: Iterable) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of Arrow batches, cut so that few megabytes of text are held as objects."""
    for batch in batches:
        ids, column = batch.column("doc_id"), batch.column("text")
        step = max(1, min(len(ids), int(len(ids) * 4e6 / (1 + column.nbytes))))
        for i in range(0, len(ids), step):
            yield ids.slice(i, step).to_pylist(), column.slice(i, step).to_pylist()


def crc32_mod(column: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
