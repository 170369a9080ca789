"""Mixing sources to target weights, with a budget in words.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share the sum of
all sizes; a target stops at `most` times its source's size and the excess is shared again by
weight. That is the water level L with sum(min(most * size, L * weight)) equal to the budget.

Each source then takes all its documents floor(target / size) times, and for the rest of its budget
once more a subset of them, found by subset sums over the counts of documents per exact length:

1. every length gives the share of its documents that the rest is of the source (rounded down);
2. the budget still open is filled with the longest lengths that fit, until no more than EXACT
   words are open;
3. a bounded-knapsack program over the remaining counts finds the sum nearest to what is open (a
   bit set of reachable sums; a count is split into powers of two).

If that misses the budget, EXACT words of it are kept back from the shares and the program fills
these as well; the better of both stays. So up to a rest of EXACT words no choice of documents comes nearer
than this one; for a larger rest none does among those that keep the shares given in steps 1 and 2.

Which documents of a length are taken is decided by a seeded hash of the doc_id and text. The range
of that hash is cut into as many salts as the square root of the number of rows. A document's rank
within its length is its rank within its salt plus the documents in the salts before; so the
largest group has about that many rows even if all documents are of one source and length. A
histogram has one row per distinct length of a source, and one task sees the list of sources.

Defined results: a null text has size 0; documents of size 0 are taken 0 times. Rows that share a
doc_id are separate documents; equal rows are told apart by rank. Extra columns are passed through
by `mix`. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20_240_601
EXACT = 100_000
_KEY, _SALT, _ORDER = "__key", "__salt", "__order"


def size_of(text: str = "text") -> Column:
    """Number of words: every word is shrunk to one letter, and the letters are counted."""
    shrunk = F.regexp_replace(F.col(text).cast("string"), r"[^\x20\x09-\x0D]+", "w")
    words = F.length(F.translate(shrunk, " \t\n\x0b\x0c\r", ""))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def water_level(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above `most` times its size."""
    total, shares = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i] and weights[i]),
                   key=lambda i: most * sizes[i] / weights[i])
    left, weight = total, float(sum(weights[i] for i in order))
    for at, i in enumerate(order):
        if left * weights[i] / weight < most * sizes[i]:
            for k in order[at:]:
                shares[k] = left * weights[k] / weight
            break
        shares[i] = float(most * sizes[i])
        left, weight = left - shares[i], weight - weights[i]
    return shares


def _nearest_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length make the sum nearest to the budget; of two as near, the smaller one."""
    # No documents at all are off by the budget, so no sum above twice the budget is nearest.
    most = min(2 * budget, sum(a * c for a, c in zip(lengths, counts, strict=True)))
    mask = (1 << (most + 1)) - 1
    reach, steps = 1, []
    found_by = np.zeros(most + 1, dtype=np.int32)  # the step that first reached a sum
    for length, count in zip(lengths, counts, strict=True):
        part = 1
        while count:
            take = min(part, count)
            if take * length > most:
                break
            new = (reach << (take * length)) & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), dtype=np.uint8)
                found_by[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                steps.append((length, take))
                reach |= new
            count, part = count - take, part * 2
        if reach >> budget & 1:
            break
    goal = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    if above:
        over = budget + 1 + (above & -above).bit_length() - 1
        goal = over if over - budget < budget - goal else goal
    chosen: dict[int, int] = {}
    while goal:
        length, take = steps[found_by[goal]]
        chosen[length] = chosen.get(length, 0) + take
        goal -= take * length
    return chosen


def _filled(lengths: list[int], counts: list[int], budget: int, held: int, exact: int) -> list[int]:
    """Steps 1 to 3, with `held` words of the budget kept back from the shares."""
    whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
    shared = max(0, budget - held)
    taken = [c * shared // whole if whole and a else 0 for a, c in zip(lengths, counts, strict=True)]
    left = budget - sum(a * t for a, t in zip(lengths, taken, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])
    for i in order:
        if left <= held + exact:
            break
        more = min(counts[i] - taken[i], (left - held - exact // 2) // lengths[i])
        if more > 0:
            taken[i] += more
            left -= more * lengths[i]
    chosen = _nearest_sum([lengths[i] for i in order], [counts[i] - taken[i] for i in order], left)
    for i in order:
        taken[i] += chosen.get(lengths[i], 0)
    return taken


def fit_counts(lengths: Iterable[int], counts: Iterable[int], budget: int,
               exact: int = EXACT) -> list[int]:
    """How many documents of each (distinct) length to take so that their words come near the budget."""
    lengths, counts = list(map(int, lengths)), list(map(int, counts))
    whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
    budget = min(max(0, int(budget)), whole)
    tries = []
    for held in (0, exact):
        taken = _filled(lengths, counts, budget, held, exact)
        tries.append((abs(sum(a * t for a, t in zip(lengths, taken, strict=True)) - budget), taken))
        if tries[-1][0] == 0:
            break
    return min(tries, key=lambda t: t[0])[1]


def _targets(sources: pd.DataFrame) -> pd.DataFrame:
    """One row per source: a table as long as the list of sources."""
    # Keys of sources begin with "=", that of the null source is "~": it sorts last.
    sources = sources.sort_values(_KEY, key=lambda keys: keys.map(lambda k: k.encode("utf-32-be")))
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sources))]
    shares = water_level([int(n) for n in sources["source_size"]], weights, MOST)
    return sources[[_KEY, "source_size"]].assign(target=shares)


def _counts_taken(part: pd.DataFrame) -> pd.DataFrame:
    """Times each length is taken whole, and documents of it taken once more."""
    size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
    epochs = min(MOST, int(target // size)) if size else 0
    rest = round(target) - epochs * size if epochs < MOST else 0
    part = part.sort_values("size")
    taken = np.array(fit_counts(part["size"], part["n"], rest), dtype=np.int64)
    return part.assign(epochs=epochs, extra=taken)[
        [_KEY, "size", "source_size", "target", "epochs", "extra"]]


def _mixed(sized: DataFrame, seed: int) -> DataFrame:
    """Adds source_size, target and repeats to rows with doc_id, source, size and a hash."""
    salts = max(1, math.isqrt(sized.count()))
    source = F.col("source").cast("string")
    keyed = (sized.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), source), F.lit("~")))
             .withColumn(_SALT, F.pmod(F.shiftright(_ORDER, 16), F.lit(salts))))
    groups = [_KEY, "size", _SALT]

    per_salt = keyed.groupBy(*groups).agg(F.count("*").alias("n"))
    per_length = per_salt.groupBy(_KEY, "size").agg(F.sum("n").alias("n"))
    totals = per_length.groupBy(_KEY).agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _targets, f"{_KEY} string, source_size bigint, target double")
    taken = per_length.join(targets, _KEY).groupBy(_KEY).applyInPandas(
        _counts_taken, f"{_KEY} string, size bigint, source_size bigint, target double, "
                       "epochs int, extra bigint")

    earlier = (Window.partitionBy(_KEY, "size").orderBy(_SALT)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (per_salt.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
               .join(taken, [_KEY, "size"]).drop("n"))
    within = Window.partitionBy(*groups).orderBy(_ORDER, "doc_id")
    ranked = keyed.withColumn("__rank", F.row_number().over(within))
    repeats = F.when(F.col("size") == 0, 0).otherwise(
        F.col("epochs") + (F.col("__before") + F.col("__rank") <= F.col("extra")).cast("int"))
    return (ranked.join(offsets, groups).withColumn("repeats", repeats)
            .drop(_KEY, _SALT, _ORDER, "__rank", "__before", "epochs", "extra"))


def _order(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed)).alias(_ORDER)


def _numbered(docs: DataFrame, names: list[str], seed: int) -> DataFrame:
    """What the mix needs, and columns under numbers, so that their names cannot clash."""
    kept = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)]
    return _mixed(docs.select("doc_id", "source", size_of().alias("size"), _order(seed), *kept), seed)


def mix(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """The documents with size, source_size, target and `repeats`, the times each is taken.

    The new columns replace columns of the same names.
    """
    new = ("size", "source_size", "target", "repeats")
    names = [c for c in docs.columns if c.lower() not in new]
    return _numbered(docs, names, seed).select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)], *new)


def repeated(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """The documents as rows, each as often as the mix takes it, with their own columns only."""
    names = docs.columns
    taken = _numbered(docs, names, seed).where("repeats > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")
    numbered = [F.col(f"kept_{i}") for i in range(len(names))]
    return taken.select(*numbered, copies).select(
        *[c.alias(n) for c, n in zip(numbered, names, strict=True)])


def mixed_sizes(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """As `mix`, with doc_id and source only: no text is shuffled."""
    return _mixed(docs.select("doc_id", "source", size_of().alias("size"), _order(seed)), seed)
