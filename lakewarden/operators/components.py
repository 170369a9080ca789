"""Connected components of a graph of links, as DataFrame steps over written tables.

Links shrink to stars around the smallest node of each component by two steps in turn: every node
sends its larger neighbours to the smallest node it knows (large star), then its smaller ones (small
star). Each step keeps components as they are, and the number of rounds grows with the logarithm of
the longest path. A node is nowhere gathered with its neighbours: the smallest one is a partial
minimum, joined back with a salted join, so a node with very many links is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.keyed import Skew, salted_join
from lakewarden.sources.store import staged

_LARGER, _SMALLER = "b > a", "b < a"


def _star(links: DataFrame, side: str, skew: Skew) -> DataFrame:
    """Neighbours of each node on one side go to the smallest neighbour; a node is its own one."""
    both = links.unionAll(links.select("b", "a"))
    known = both if side == _LARGER else both.where(side)
    smallest = known.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
    moved = salted_join(both.where(side), smallest, ["a"], ["node"], "inner", skew=skew).select(
        F.col("b").alias("a"), F.col("to").alias("b"))
    if side == _SMALLER:  # the node itself goes along
        moved = moved.unionAll(smallest.select(F.col("node").alias("a"), F.col("to").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, *, skew: Skew = Skew()) -> DataFrame:
    """node, component (the smallest node reachable), for every node with a link to another one.

    `links` has two columns of whole numbers; their order, loops and repetitions do not matter, and
    links with a NULL are left out.
    """
    a, b = (F.col(c).cast("bigint") for c in links.columns[:2])
    given = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.alias("x"), b.alias("y"))
    stars = staged(given.where("x <> y").select("a", "b").distinct(), "links")
    state = None
    while True:
        # The rounds end when the links are what they were; a sum over hashes tells.
        facts = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if facts == state:
            return (stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .unionAll(stars.select("b", "b").distinct()))
        state = facts
        stars = staged(_star(staged(_star(stars, _LARGER, skew), "links"), _SMALLER, skew), "links")
