"""Pairs of records by number: any part of a block's pairs can be made without making the others.

The records of a block are numbered from 0 in the order of id, name and copy. The pair of numbers
i < j has rank j(j-1)/2 + i in its block, and blocks follow each other in text order; so every pair
has one rank in the whole table, and from a rank the two records are found by arithmetic and two
look-ups. Listing all pairs is quadratic and never needed:

* `pair_slice` gives the pairs of a range of ranks, for instance as evidence of rejects;
* `mean_confidence` visits all pairs of small blocks and draws ranks in large ones.

Two records with one id are no pair (as in `match_pairs`); their ranks give no row. A block may have up
to 3 * 10**9 records. Records without block or id are in no pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import Thresholds
from lakewarden.operators.keyed import Skew, salted_join
from lakewarden.operators.match_pairs import score_all
from lakewarden.sources.store import staged

EXACT_PAIRS = 1_000_000  # blocks with more pairs are sampled
DRAWS = 100_000  # ranks drawn in each of these
Z_99 = 2.5758293035489004  # two-sided 99 % of the normal distribution
RANKS_PER_ROW = 10_000  # ranks are dealt to tasks in runs of so many
_RANK = "decimal(38,0)"


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before this one. `order` must be unique.

    Rows are laid out by range and written, each range is summed by its own task, and only one
    number per range is summed in one place.
    """
    laid = staged(df.withColumn("__value", value.cast(_RANK)).repartitionByRange(*order)
                  .withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = (Window.unboundedPreceding, -1)
    totals = laid.groupBy("__range").agg(F.sum("__value").alias("__total"))
    before = totals.select(
        F.col("__range").alias("__of"),
        F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(*earlier)), F.lit(0))
        .alias("__before"))
    within = F.sum("__value").over(
        Window.partitionBy("__range").orderBy(*order).rowsBetween(*earlier))
    # One row per range: as many as the exchange has partitions.
    return (laid.withColumn("__within", F.coalesce(within, F.lit(0)))
            .join(F.broadcast(before), F.col("__range") == F.col("__of"))
            .withColumn(name, (F.col("__before") + F.col("__within")).cast(_RANK))
            .drop("__value", "__range", "__of", "__before", "__within"))


def numbered(member_rows: DataFrame) -> DataFrame:
    """The records behind `match_pairs.members`: block, name, id, and position in the block."""
    # A null name sorts first in ranges and windows alike.
    records = member_rows.select("block", "id", "name",
                                 F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("copy"))
    placed = staged(running_sum(records, ("block", "id", "name", "copy"), F.lit(1), "__at"),
                    "numbered-records")
    starts = placed.groupBy(F.col("block").alias("__block")).agg(F.min("__at").alias("__start"))
    return (salted_join(placed, starts, ["block"], ["__block"], "inner")
            .select("block", "name", "id",
                    (F.col("__at") - F.col("__start")).cast("bigint").alias("position")))


def blocks_of(records: DataFrame) -> DataFrame:
    """Per block: ranks (how many pairs of positions) and first_rank (those of earlier blocks)."""
    ranks = F.expr("CAST(n AS DECIMAL(20,0)) * (n - 1) / 2").cast(_RANK)
    sizes = records.groupBy("block").agg(F.count("*").alias("n")).withColumn("ranks", ranks)
    return running_sum(sizes.drop("n"), ("block",), F.col("ranks"), "first_rank")


def _each_rank(ranges: DataFrame) -> DataFrame:
    """Rows with bigint columns `low` and `high` (exclusive) as one row per rank between them."""
    step = F.lit(RANKS_PER_ROW).cast("bigint")
    runs = ranges.where("low < high").select(
        "block", "high", F.explode(F.sequence("low", F.col("high") - 1, step)).alias("low"))
    return runs.repartition("block", "low").select("block", F.explode(F.sequence(
        "low", F.least(F.col("low") + step, "high") - 1)).alias("rank"))


def pairs_at(records: DataFrame, ranks: DataFrame, thresholds: Thresholds = Thresholds(), *,
             skew: Skew = Skew()) -> DataFrame:
    """The scored pairs at the given (block, rank), the smaller id first."""
    guess = F.expr("CAST(floor((1 + sqrt(1 + 8 * CAST(rank AS DOUBLE))) / 2) AS BIGINT)")
    # The root is off by one at most where ranks pass 2**53.
    placed = ranks.withColumn("j", guess).withColumn("j", F.expr(
        "CASE WHEN j * (j - 1) DIV 2 > rank THEN j - 1 WHEN (j + 1) * j DIV 2 <= rank THEN j + 1"
        " ELSE j END")).withColumn("i", F.expr("rank - j * (j - 1) DIV 2"))

    def side(number: str) -> DataFrame:
        return records.select(F.col("block").alias(f"block_{number}"),
                              F.col("position").alias(f"at_{number}"),
                              F.col("id").alias(f"id_{number}"), F.col("name").alias(f"name_{number}"))

    found = salted_join(placed, side("a"), ["block", "i"], ["block_a", "at_a"], "inner", skew=skew)
    found = salted_join(found, side("b"), ["block", "j"], ["block_b", "at_b"], "inner", skew=skew)
    return score_all(found.where("id_a <> id_b").select(
        "block", "rank", "id_a", "id_b", "name_a", "name_b"), thresholds)


def pair_slice(records: DataFrame, blocks: DataFrame, first: int, count: int,
               thresholds: Thresholds = Thresholds(), *, skew: Skew = Skew()) -> DataFrame:
    """The scored pairs whose rank in the whole table is at least `first`, `count` ranks of them.

    `records` come from `numbered`, `blocks` from `blocks_of`. Only blocks of the slice, and in these
    only records up to the last one that the slice meets, are looked up.
    """
    start = F.lit(first).cast(_RANK) - F.col("first_rank")
    low, high = F.greatest(F.lit(0).cast(_RANK), start), F.least("ranks", start + F.lit(count))
    ranges = blocks.select("block", low.cast("bigint").alias("low"),
                           high.cast("bigint").alias("high")).where("low < high")
    last = ranges.select(F.col("block").alias("__block"), F.expr(
        "CAST(ceil((1 + sqrt(1 + 8 * CAST(high AS DOUBLE))) / 2) AS BIGINT) + 1").alias("__last"))
    met = salted_join(records, last, ["block"], ["__block"], "inner", skew=skew).where(
        "position <= __last").drop("__block", "__last")
    return pairs_at(met, _each_rank(ranges), thresholds, skew=skew)


def rejects(pairs: DataFrame) -> DataFrame:
    """The evidence rows among scored pairs: those that were turned down."""
    return pairs.filter(F.col("decision") == fv.REJECT).select(
        "id_a", "id_b", "name_a", "name_b", "block", "name_similarity", "match_confidence", "decision")


def mean_confidence(member_rows: DataFrame, thresholds: Thresholds = Thresholds(), *,
                    exact_pairs: int = EXACT_PAIRS, draws: int = DRAWS, seed: int = 11,
                    skew: Skew = Skew()) -> DataFrame:
    """One row: the average confidence of all pairs of records, matched or not, and where it lies.

    total_pairs, avg_confidence, low and high (99 % interval), sampled_blocks. Blocks with up to
    `exact_pairs` pairs are visited whole. In larger ones `draws` ranks are drawn with replacement
    from a seeded hash, and the blocks are put together by their exact numbers of pairs. Without
    sampled blocks the interval is the average itself. As in SQL, pairs without a confidence
    (a name is NULL) do not count; with no pair at all the average is NULL.
    """
    records = staged(numbered(member_rows.where("name IS NOT NULL")), "ranked-records")
    per_id = records.groupBy("block", "id").agg(F.count("*").cast("decimal(20,0)").alias("m"))
    sizes = per_id.groupBy("block").agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same")).select(
        "block", (F.col("n") * (F.col("n") - 1) / 2).cast(_RANK).alias("ranks"),
        (F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast(_RANK).alias("pairs"))
    sizes = staged(sizes.where("pairs > 0").withColumn("sampled", F.col("ranks") > exact_pairs),
                   "pairs-of-blocks")
    whole = _each_rank(sizes.where("NOT sampled").select(
        "block", F.lit(0).cast("bigint").alias("low"), F.col("ranks").cast("bigint").alias("high")))
    drawn = _each_rank(sizes.where("sampled").select(
        F.col("block"), F.lit(0).cast("bigint").alias("low"),
        F.lit(draws).cast("bigint").alias("high"))).withColumnRenamed("rank", "draw").join(
        sizes.select("block", F.col("ranks").cast("bigint").alias("ranks")), "block").select(
        "block", F.pmod(F.xxhash64("block", "draw", F.lit(seed)), "ranks").alias("rank"))
    scored = pairs_at(records, whole.unionByName(drawn), thresholds, skew=skew)
    seen = scored.groupBy("block").agg(
        F.count("match_confidence").alias("seen"), F.avg("match_confidence").alias("mean"),
        F.var_samp("match_confidence").alias("spread"))
    weight = F.col("pairs").cast("double")
    # A block whose draws all met one id twice, or that gave one pair only, may lie anywhere in 0 to 1.
    mean = F.coalesce("mean", F.lit(0.5))
    error = F.when(F.col("sampled"), F.when(F.col("seen") > 1, F.col("spread") / F.col("seen"))
                   .otherwise(0.25)).otherwise(0.0)
    totals = sizes.join(seen, "block", "left").agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast(_RANK).alias("total_pairs"),
        F.try_divide(F.sum(mean * weight), F.sum(weight)).alias("avg_confidence"),
        F.try_divide(F.sqrt(F.sum(error * weight * weight)), F.sum(weight)).alias("__error"),
        F.count_if("sampled").alias("sampled_blocks"))
    reach = F.col("__error") * Z_99
    return totals.select("total_pairs", "avg_confidence",
                         F.greatest(F.lit(0.0), F.col("avg_confidence") - reach).alias("low"),
                         F.least(F.lit(1.0), F.col("avg_confidence") + reach).alias("high"),
                         "sampled_blocks")
