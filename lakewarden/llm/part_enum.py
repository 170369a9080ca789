"""PartEnum signatures: sets of hashes whose Jaccard similarity reaches a bound share a signature.

Sizes fall into bands [l, floor(l / similarity)]. Instance i serves pairs whose larger set lies in
band i; its sets have sizes from bands i - 1 and i, so every set takes part in two instances. Two
such sets differ in at most k elements, k = floor(2 r (1 - s) / (1 + s)) for the upper end r of
band i. The hashed domain is cut into n1 groups of n2 parts. Differences in at most k elements leave
at least m = n1 - floor(k / (k2 + 1)) groups with at most k2 differences, and in each of these some
n2 - k2 parts without any; a signature is the content of n2 - k2 parts of one group.

A signature of empty parts says nothing and would be shared by all sets. A group with more than k2
parts in use has no such signature, so a set with fewer than m other ("thin") groups shares one that
is not empty with every partner. Only sets with m thin groups or more emit empty ones as well, and
meet only each other on them. Sets that are equal are not told apart here: instances with k = 0
have no signatures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np

from lakewarden.llm.text import mix


@dataclass(frozen=True)
class Shape:
    """Parameters of an instance."""

    instance: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def needed(self) -> int:
        """Groups in which two partners have at most k2 differences."""
        return self.n1 - self.k // (self.k2 + 1)


@cache
def bands(percent: int, upto: int) -> tuple[int, ...]:
    """Upper ends of the bands, the first of which begins at 1."""
    ends, low = [], 1
    while low <= upto:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return tuple(ends)


def band_of(size: int, percent: int) -> int:
    ends = bands(percent, 1 << max(1, size - 1).bit_length())
    return int(np.searchsorted(ends, size))


@cache
def shape(instance: int, percent: int) -> Shape | None:
    ends = bands(percent, 1 << 16)
    upto = 1 << 16
    while len(ends) <= instance:
        upto *= 4
        ends = bands(percent, upto)
    k = 2 * ends[instance] * (100 - percent) // (100 + percent)
    if not k:
        return None
    if k <= 3:
        return Shape(instance, k, 1, k + 2, k)
    if k <= 24:
        return Shape(instance, k, k // 3 + 1 + k // 12, 5, 2)
    return Shape(instance, k, k // 2 + k // 20 + 2, 3, 1)


@dataclass(frozen=True)
class Signatures:
    """Signatures of some sets in one instance, in the order of `owner`."""

    hashes: np.ndarray
    owner: np.ndarray  # index of the set
    group: np.ndarray
    need: np.ndarray  # per set: groups in which a partner of it shares a signature, at least


def signatures(sets: list[np.ndarray], shape: Shape) -> Signatures:
    """Signatures of sets of distinct 64-bit hashes, all within the sizes of the instance."""
    n, parts = len(sets), shape.n1 * shape.n2
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    place = mix(values, 1000 + shape.instance)
    low = np.uint64(0xFFFFFFFF)
    group = ((place >> np.uint64(32)) * np.uint64(shape.n1)) >> np.uint64(32)
    part = ((place & low) * np.uint64(shape.n2)) >> np.uint64(32)
    cell = owner * parts + (group * np.uint64(shape.n2) + part).astype(np.int64)
    content = np.zeros(n * parts, dtype=np.uint64)
    np.add.at(content, cell, mix(values, 7))
    used = np.bincount(cell, minlength=n * parts).astype(bool).reshape(n, shape.n1, shape.n2)
    content = content.reshape(n, shape.n1, shape.n2)
    thin = (used.sum(axis=2) <= shape.k2).sum(axis=1)
    sparse = thin >= shape.needed
    found = []
    groups = np.arange(shape.n1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        each = [mix(content[:, :, p], 3 + p) for p in range(shape.n2)]
        for number, chosen in enumerate(combinations(range(shape.n2), shape.n2 - shape.k2)):
            salt = mix(groups * np.uint64(64) + np.uint64(number), 2000 + shape.instance)
            hashes = mix(sum((each[p] for p in chosen[1:]), each[chosen[0]]) + salt)
            some = used[:, :, list(chosen)].any(axis=2) | sparse[:, None]
            at, g = np.nonzero(some)
            found.append((hashes[at, g], at, g))
    hashes, at, g = (np.concatenate(c) for c in zip(*found, strict=True))
    need = np.where(sparse, shape.needed, shape.needed - thin)
    return Signatures(hashes, at, g, need)


def all_signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, ...]:
    """Hash, set and check number of every signature of every set; and per check number its set and
    need. A check number stands for one set in one instance; signature rows carry their group too."""
    by_instance: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            band = band_of(len(s), percent)
            by_instance.setdefault(band, []).append(i)
            by_instance.setdefault(band + 1, []).append(i)
    out: list[tuple[np.ndarray, ...]] = []
    owners, needs, checks = [], [], 0
    for instance, members in sorted(by_instance.items()):
        form = shape(instance, percent)
        if form is None:
            continue
        for start in range(0, len(members), 512):
            chosen = members[start:start + 512]
            found = signatures([sets[i] for i in chosen], form)
            index = np.array(chosen)
            out.append((found.hashes, index[found.owner], found.owner + checks, found.group))
            owners.append(index)
            needs.append(found.need)
            checks += len(chosen)
    if not out:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none, none, none, none
    return (*(np.concatenate(c) for c in zip(*out, strict=True)),
            np.concatenate(owners), np.concatenate(needs))


def reaches(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with so many common elements are similar enough."""
    return 100 * common >= percent * (a + b - common)


PARITY_WORDS = 16


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A bit map per set, in which every element turns one of 1024 bits over.

    Two maps differ in at most as many bits as the sets in elements.
    """
    bit_map = np.zeros((len(sets), 64 * PARITY_WORDS), dtype=bool)
    for i, s in enumerate(sets):
        bit_map[i] = np.bincount((mix(s, 5) >> np.uint64(54)).astype(np.int64),
                                 minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bit_map, axis=1).view(np.uint64)


def may_reach(maps_a: np.ndarray, size_a: np.ndarray, maps_b: np.ndarray, size_b: np.ndarray,
              percent: int) -> np.ndarray:
    """False only for pairs that cannot be similar enough, by sizes and bit maps."""
    differ = np.bitwise_count(maps_a ^ maps_b).sum(axis=-1, dtype=np.int64)
    total = size_a + size_b
    # With d different elements, common = (total - d) / 2 and the union (total + d) / 2.
    return 100 * (total - differ) >= percent * (total + differ)
