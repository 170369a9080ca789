"""Matching by pairwise name similarity inside a block.

A block of n records has n(n-1)/2 pairs, so pairs are neither listed nor scored one by one:

* Records are first reduced to distinct names per block, with the number of records behind
  each name. Copies, however many, are one row from here on.
* Names that can reach the medium threshold are found by a join on shared pieces. Cut a name
  into more pieces than the edits the threshold allows: at least one piece is then found
  unchanged in any name that is close enough, near its old place. Each name offers its pieces
  under its own length; each name also looks for such pieces at all lengths and places within
  reach. Only names that meet on a piece are compared, and the comparison is the full score,
  so the result is exactly the pairs at or above the threshold.
* Names with the same first token may differ more and would need many signatures. Where only a
  few names share the token they meet on the token itself.
* Pairs below the threshold are the rest of the block. Their number is computed from the block
  sizes, not by visiting them.

One result row stands for a pair of names and carries the number of record pairs behind it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import ConfigError, Thresholds
from lakewarden.functions.columns import require_columns, run_time, stamp
from lakewarden.functions.matching import (
    composite_key,
    decision,
    edit_similarity,
    first_token,
    normalized,
    pair_confidence,
    token_agreement,
)
from lakewarden.operators.components import components
from lakewarden.operators.keyed import Skew, heavy_keys, salted_join, with_group_size
from lakewarden.sources.store import staged

# Up to this many names with one first token are compared directly: at most this many partners
# each cost less than the signatures of their pieces. Larger groups are always cut.
DIRECT_NAMES = 64
# Pieces of longer names are looked for anywhere in the partner, not place by place: the number of
# signatures then grows with the length of a name instead of its cube.
LONG_NAME = 64
# So many comparisons of names weigh as much as one row of a join.
COMPARISONS_PER_ROW = 1000
_ROUNDING = 0.5 * 10 ** -fv.SCORE_DIGITS + 1e-9
_COUNT = "decimal(38,0)"


def prepare(records: DataFrame, id_column: str, name_column: str,
            block_column: str | None) -> DataFrame:
    """Add normalized name, normalized block and the exact match key.

    Without a block column all records form one block.
    """
    wanted = [id_column, name_column] + ([block_column] if block_column else [])
    require_columns(records, wanted, "master-data table")
    block = normalized(F.col(block_column)) if block_column else F.lit(fv.MISSING_AREA)
    return records.withColumns({
        "name_norm": normalized(F.col(name_column)), "block_norm": block,
    }).withColumn("match_key", composite_key(F.col("block_norm"), F.col("name_norm")))


def members(prepared: DataFrame, id_column: str) -> DataFrame:
    """Records that can be in a pair, as (block, name, id) with how often each occurs."""
    return (
        prepared.select(F.col("block_norm").alias("block"), F.col("name_norm").alias("name"),
                        F.col(id_column).alias("id"))
        .filter("block IS NOT NULL AND id IS NOT NULL")
        .groupBy("block", "name", "id").agg(F.count("*").alias("m"))
    )


def _pairs_in(n: Column) -> Column:
    whole = n.cast("decimal(20,0)")
    return (whole * (whole - 1) / 2).cast(_COUNT)


def name_groups(member_rows: DataFrame) -> DataFrame:
    """Distinct names per block: records, smallest id, and pairs of records with unlike ids."""
    return (
        member_rows.filter("name IS NOT NULL AND name <> ''")
        .groupBy("block", "name").agg(
            F.sum("m").alias("records"),
            F.min("id").alias("first_id"),
            F.sum(_pairs_in(F.col("m"))).cast(_COUNT).alias("same_id_pairs"),
        )
        .withColumn("pair_count",
                    (_pairs_in(F.col("records")) - F.col("same_id_pairs")).cast(_COUNT))
        .drop("same_id_pairs")
    )


def block_totals(member_rows: DataFrame) -> DataFrame:
    """Records and record pairs per block (two records pair up if their ids differ)."""
    per_id = member_rows.groupBy("block", "id").agg(F.sum("m").alias("m"))
    return (
        per_id.groupBy("block").agg(
            F.sum("m").alias("records"), F.sum(_pairs_in(F.col("m"))).alias("same_id_pairs"))
        .select("block", "records",
                (_pairs_in(F.col("records")) - F.col("same_id_pairs")).cast(_COUNT)
                .alias("total_pairs"))
    )


@dataclass(frozen=True)
class _Reach:
    """How far apart two names may be, for one outcome of the first-token test.

    Names with the same first token differ only after it, so for these only the tail is cut, from
    behind the blank that follows the token, and the token is part of the signature. Texts below are SQL over the columns of `_cuttable`.
    """

    prefix: str
    lead: str  # letters before the rest: the token and the blank after it
    rest: str
    reach: str  # column with the most edits between this name and one that is no longer
    least: float  # smallest edit similarity that can still reach the medium threshold

    def edits(self, length: str) -> str:
        """Most edits between two names of which the longer has this length."""
        if self.least <= 0:  # nothing in common is enough
            return f"CAST({length} AS INT)"
        return f"CAST(floor({length} * {1.0 - self.least!r}D + 1e-9D) AS INT)"

    def pieces(self, length: str) -> str:
        """Pieces of a name of this length: one more than the edits to any possible partner.

        Where that is more than the name has letters, it is not cut, and names of its length meet.
        """
        if self.least <= 0:
            return f"(CAST({length} AS INT) + 1)"
        longest_partner = f"floor({length} / {self.least!r}D + 1e-9D)"
        return f"({self.edits(longest_partner)} + 1)"

    def signature(self, length: str, piece_number: str, piece: str) -> str:
        return f"xxhash64(block, {self.prefix}, {length}, {piece_number}, {piece})"

    def uncut(self, length: str) -> str:
        """For names with too little text to cut: all of that length and prefix meet."""
        return f"array({self.signature(length, '-1', repr(''))})"

    def loose_signature(self, piece: str) -> str:
        return f"xxhash64(block, {self.prefix}, 'anywhere', {piece})"

    def offered(self) -> str:
        """Signatures of a name's own pieces."""
        pieces, size = self.pieces("len"), f"length({self.rest})"
        start, end = _cut("i", pieces, size), _cut("i + 1", pieces, size)
        piece = f"substring({self.rest}, {start} + 1, {end} - {start})"
        return (
            f"CASE WHEN {size} < {pieces} THEN {self.uncut('len')}"
            f" ELSE transform(sequence(0, {pieces} - 1), i ->"
            f" IF(len <= {LONG_NAME}, {self.signature('len', 'i', piece)},"
            f" {self.loose_signature(piece)})) END"
        )

    def sought(self) -> str:
        """Signatures that a partner of the same length or shorter may offer."""
        shortest = f"greatest(len - {self.reach}, length({self.prefix}), 1)"
        return f"concat({self._sought_in_place(shortest)}, {self._sought_anywhere(shortest)})"

    def _sought_in_place(self, shortest: str) -> str:
        """Pieces of partners that are not long.

        With d the shift of a piece and s the difference in length, d edits are spent before
        the piece and |s - d| after it, which limits where the piece can be.
        """
        partner = f"greatest(n - {self.lead}, 0)"
        start = _cut("i", "m", partner)
        cut = f"struct({start} AS start, {_cut('i + 1', 'm', partner)} - {start} AS size)"
        first = f"greatest(0, c.start - CAST(floor(({self.reach} - len + n) / 2) AS INT))"
        last = (f"least(length({self.rest}) - c.size,"
                f" c.start + CAST(floor(({self.reach} + len - n) / 2) AS INT))")
        found = self.signature("n", "i", f"substring({self.rest}, p + 1, c.size)")
        places = _let("c", cut, f"transform({_span(first, last)}, p -> {found})")
        each = (f"CASE WHEN {partner} >= m THEN flatten(transform(sequence(0, m - 1), i -> {places}))"
                f" ELSE {self.uncut('n')} END")
        lengths = _span(shortest, f"least(len, {LONG_NAME})")
        return f"flatten(transform({lengths}, n -> {_let('m', self.pieces('n'), each)}))"

    def _sought_anywhere(self, shortest: str) -> str:
        """Pieces of long partners: all substrings of the sizes that their pieces have."""
        pieces, partner = self.pieces("n"), f"greatest(n - {self.lead}, 0)"
        lengths = _span(f"greatest({shortest}, {LONG_NAME} + 1)", "len")
        size = f"CAST(floor({partner} / {pieces}) AS INT)"
        sizes = f"array_distinct(flatten(transform({lengths}, n -> array({size}, {size} + 1))))"
        piece = f"substring({self.rest}, p, z)"
        found = (
            f"flatten(transform(filter({sizes}, z -> z > 0), z -> transform("
            f"{_span('1', f'length({self.rest}) - z + 1')}, p -> {self.loose_signature(piece)})))"
        )
        uncut = (f"flatten(transform(filter({lengths}, n -> {partner} < {pieces}),"
                 f" n -> {self.uncut('n')}))")
        return f"concat({found}, {uncut})"


def _cut(i: str, pieces: str, length: str) -> str:
    """Start of piece i when a text of this length is cut evenly."""
    return f"CAST(floor(({i}) * {length} / {pieces}) AS INT)"


def _let(variable: str, value: str, array_text: str) -> str:
    """An array expression in which the variable stands for a value that is computed once."""
    return f"flatten(transform(array({value}), {variable} -> {array_text}))"


def _span(first: str, last: str) -> str:
    """Whole numbers from first to last; none if last is smaller."""
    return (f"CASE WHEN {first} <= {last} THEN sequence({first}, {last})"
            " ELSE CAST(array() AS array<int>) END")


def _reaches(thresholds: Thresholds) -> dict[bool, _Reach]:
    """By whether the first tokens agree; an outcome that cannot reach the threshold is absent."""
    found = {}
    for agree, prefix, lead, rest, reach in (
            (True, "token", "(length(token) + 1)", "tail", "reach_alike"),
            (False, "''", "0", "name", "reach_other")):
        boost = fv.TOKEN_WEIGHT if agree else 0.0
        least = (thresholds.medium - _ROUNDING - boost) / fv.NAME_WEIGHT - _ROUNDING
        if least <= 1.0:
            found[agree] = _Reach(prefix, lead, rest, reach, least)
    return found


def _cuttable(groups: DataFrame, reaches: Iterable[_Reach], skew: Skew) -> DataFrame:
    named = groups.select(
        "block", "name", "records", "first_id", F.length("name").alias("len"),
        first_token(F.col("name")).alias("token"), *[c for c in ("node",) if c in groups.columns],
    ).withColumn("tail", F.expr("substring(name, length(token) + 2)"))
    sized = with_group_size(named, ["block", "token"], "token_names", skew=skew)
    return sized.withColumns({r.reach: F.expr(r.edits("len")) for r in reaches})


def _meeting(groups: DataFrame, thresholds: Thresholds, skew: Skew, direct: int
             ) -> tuple[DataFrame, DataFrame, Column]:
    """Names under the signatures they offer (side a) and seek (side b), and the test that pairs which
    met have to pass: shorter (or earlier) name first, and few enough edits."""
    reaches = _reaches(thresholds)
    names = _cuttable(groups, reaches.values(), skew)

    def under(signatures: dict[bool, str], side: str) -> DataFrame:
        if True in signatures:
            signatures = signatures | {True: (
                f"CASE WHEN token_names <= {direct} THEN array(xxhash64(block, token))"
                f" ELSE {signatures[True]} END")}
        distinct = f"array_distinct(concat({', '.join(signatures.values())}))"
        return names.select(
            F.explode(F.expr(distinct)).alias(f"sig_{side}"),
            *[F.col(c).alias(f"{c}_{side}")
              for c in ("block", "name", "records", "first_id", "len", "token", *carried)])

    carried = [c for c in ("node",) if c in names.columns]
    offered = under({agree: r.offered() for agree, r in reaches.items()}, "a")
    sought = under({agree: r.sought() for agree, r in reaches.items()}, "b")
    allowed = {agree: r.edits("len_b") for agree, r in reaches.items()}
    # levenshtein stops counting past the limit and gives -1; the full score is for the few left.
    near = (
        "block_a = block_b AND (len_a < len_b OR (len_a = len_b AND name_a < name_b))"
        f" AND levenshtein(name_a, name_b, CASE WHEN token_a = token_b THEN {allowed.get(True, '-1')}"
        f" ELSE {allowed.get(False, '-1')} END) >= 0"
    )
    return offered, sought, F.expr(near)


def _met(offered: DataFrame, sought: DataFrame, skew: Skew) -> DataFrame:
    """Every name that offers a signature with every one that seeks it."""
    # A signature is as heavy as the comparisons it causes: offered times sought names.
    sides = offered.select("sig_a", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        sought.select("sig_b", F.lit(0), F.lit(1)))
    counts = sides.groupBy("sig_a").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(
        "sig_a", F.greatest("a", (F.col("a") * F.col("b") / COMPARISONS_PER_ROW).cast("bigint"))
        .alias("n"))
    return salted_join(offered, sought, ["sig_a"], ["sig_b"], "inner",
                       heavy=heavy_keys(counts, "n", skew), skew=skew)


def _close_names(groups: DataFrame, thresholds: Thresholds, skew: Skew, direct: int) -> DataFrame:
    """Pairs of unlike names that may reach the medium threshold: shorter (or earlier) name first.

    A pair can appear more than once, as two names may meet on several pieces.
    """
    offered, sought, near = _meeting(groups, thresholds, skew, direct)
    return _met(offered, sought, skew).filter(near).select(
        F.col("block_a").alias("block"), "name_a", "name_b", "records_a", "records_b",
        "first_id_a", "first_id_b")


def score_all(pairs: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Similarity, confidence and decision of pairs with name_a and name_b, rejects included."""
    tokens = {"token_a": first_token(F.col("name_a")), "token_b": first_token(F.col("name_b"))}
    return (
        pairs.withColumns({
            "name_similarity": edit_similarity(F.col("name_a"), F.col("name_b")), **tokens,
        })
        .withColumn("token_match", token_agreement(F.col("token_a"), F.col("token_b")))
        .withColumn("match_confidence",
                    pair_confidence(F.col("name_similarity"), F.col("token_match")))
        .withColumn("decision", decision(F.col("match_confidence"), thresholds))
    )


def _score(pairs: DataFrame, thresholds: Thresholds) -> DataFrame:
    return score_all(pairs, thresholds).filter(F.col("decision") != fv.REJECT)


def _less_shared_ids(pairs: DataFrame, member_rows: DataFrame, skew: Skew) -> DataFrame:
    """Take record pairs off that join an id with itself: ids that occur under both names of a pair.

    It starts from the pairs found: an id under very many names is not joined with itself.
    """
    by_name = member_rows.filter("name IS NOT NULL AND name <> ''")
    shared = by_name.groupBy("block", "id").agg(F.count("*").alias("names")).filter("names > 1")
    uses = staged(by_name.join(shared.drop("names"), ["block", "id"], "left_semi"), "shared-ids")
    if uses.isEmpty():
        return pairs.filter("pair_count > 0")
    side_a = uses.select(F.col("block").alias("u_block"), F.col("name").alias("u_name"),
                         F.col("id").alias("u_id"), F.col("m").alias("m_a"))
    side_b = uses.select(F.col("block").alias("v_block"), F.col("name").alias("v_name"),
                         F.col("id").alias("v_id"), F.col("m").alias("m_b"))
    # Rows: the shared ids of the first name of each pair; then one look-up by block, name and id.
    named = pairs.select("block", "name_a", "name_b")
    first = salted_join(named, side_a, ["block", "name_a"], ["u_block", "u_name"], "inner", skew=skew)
    both = salted_join(first, side_b, ["block", "name_b", "u_id"], ["v_block", "v_name", "v_id"], "inner",
                       skew=skew)
    less = both.groupBy("block", "name_a", "name_b").agg(
        F.sum(F.col("m_a").cast("decimal(19,0)") * F.col("m_b")).cast(_COUNT).alias("less"))
    return (
        pairs.join(less, ["block", "name_a", "name_b"], "left")
        .withColumn("pair_count",
                    (F.col("pair_count") - F.coalesce("less", F.lit(0))).cast(_COUNT))
        .drop("less").filter("pair_count > 0")
    )


def match_names(member_rows: DataFrame, thresholds: Thresholds = Thresholds(), *,
                skew: Skew = Skew(), direct: int = DIRECT_NAMES) -> DataFrame:
    """Name pairs at or above the medium threshold, each with its number of record pairs.

    A name shared by several records is a pair with itself. Names of unlike text are ordered by
    length, then alphabet; `first_id_*` is the smallest id behind each name. Any medium threshold
    is taken, but below about 0.5 names cannot be cut finely enough and all names of a block whose
    lengths allow it are compared.
    """
    if thresholds.high < thresholds.medium:
        raise ConfigError(f"thresholds must obey medium <= high, got {thresholds}")
    groups = name_groups(member_rows)
    same = groups.filter("pair_count > 0").select(
        "block", F.col("name").alias("name_a"), F.col("name").alias("name_b"),
        F.col("first_id").alias("first_id_a"), F.col("first_id").alias("first_id_b"),
        "pair_count",
    )
    # Two names may meet on several pieces.
    close = _close_names(groups, thresholds, skew, direct)
    once = close.dropDuplicates(["block", "name_a", "name_b"])
    counted = once.withColumn(
        "pair_count",
        (F.col("records_a").cast("decimal(19,0)") * F.col("records_b")).cast(_COUNT),
    ).drop("records_a", "records_b")
    unlike = _less_shared_ids(staged(_score(counted, thresholds), "scored-names"), member_rows, skew)
    return _score(same, thresholds).unionByName(unlike)


def block_report(member_rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Per block: records, all record pairs, and how they split over the three decisions.

    Rejects are all pairs less the matched ones, which is exact.
    """
    matched = scored.groupBy("block").agg(*[
        F.sum(F.when(F.col("decision") == d, F.col("pair_count"))).alias(out)
        for d, out in ((fv.AUTO_MERGE, "auto_merge_pairs"),
                       (fv.STEWARD_REVIEW, "steward_review_pairs"))
    ])
    zero = F.lit(0).cast(_COUNT)
    joined = block_totals(member_rows).join(matched, "block", "left")
    filled = joined.withColumns({
        c: F.coalesce(F.col(c).cast(_COUNT), zero)
        for c in ("auto_merge_pairs", "steward_review_pairs")
    })
    rest = F.col("total_pairs") - F.col("auto_merge_pairs") - F.col("steward_review_pairs")
    return filled.withColumn("reject_pairs", rest.cast(_COUNT))


def pair_audit(prepared: DataFrame, report: DataFrame, scored: DataFrame, thresholds: Thresholds,
               lineage: Mapping[str, object] | None = None) -> DataFrame:
    """One row for the whole run. The average confidence is that of the matched record pairs.

    The three inputs are reduced to one row each, stacked, and folded into one.
    """
    sums = ("total_pairs", "auto_merge_pairs", "steward_review_pairs", "reject_pairs")
    rows = prepared.agg(F.count("*").alias("total_rows"))
    pairs = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(_COUNT).alias(c) for c in sums])
    weight = F.col("pair_count").cast("double")
    mean = scored.agg(
        F.try_divide(F.sum(F.col("match_confidence") * weight), F.sum(weight))
        .alias("avg_matched_confidence"))
    stacked = rows.unionByName(pairs, allowMissingColumns=True).unionByName(
        mean, allowMissingColumns=True)
    folded = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return stamp(folded.withColumnRenamed("total_pairs", "total_pairs_compared"), {
        "high_conf_threshold": thresholds.high,
        "med_conf_threshold": thresholds.medium,
        **(lineage or {}),
    })


def steward_pairs(scored: DataFrame, *, moment: dt.datetime | None = None) -> DataFrame:
    """What a steward has to look at: one row per pair of names."""
    return stamp(scored.filter(F.col("decision") == fv.STEWARD_REVIEW), {
        "review_status": fv.REVIEW_PENDING, "submitted_at_utc": run_time(moment),
    }).select(
        "first_id_a", "first_id_b", "name_a", "name_b", "block", "name_similarity",
        "match_confidence", "decision", "pair_count", "review_status", "submitted_at_utc",
    )


def by_confidence(scored: DataFrame) -> DataFrame:
    """Best matches first; ties in a fixed order."""
    return scored.orderBy(F.desc("match_confidence"), "block", "name_a", "name_b")


def merge_links(member_rows: DataFrame, *, skew: Skew = Skew()) -> DataFrame:
    """Each record of a shared name with the record it merges into (the smallest id).

    One row per record, where listing pairs would need one row per two records.
    """
    groups = name_groups(member_rows).filter("records > 1").select(
        F.col("block").alias("group_block"), F.col("name").alias("group_name"),
        F.col("first_id").alias("survivor_id"), "records")
    named = member_rows.filter("name IS NOT NULL AND name <> ''").drop("m")
    counts = groups.select("group_block", "group_name", "records")
    joined = salted_join(named, groups, ["block", "name"], ["group_block", "group_name"], "inner",
                         heavy=heavy_keys(counts, "records", skew), skew=skew)
    return joined.drop("group_block", "group_name")


def merge_clusters(member_rows: DataFrame, least: float = fv.HIGH_CONFIDENCE, *, skew: Skew = Skew(),
                   direct: int = DIRECT_NAMES) -> DataFrame:
    """Each record with the record it merges into when every match of `least` or more is followed.

    block, name, id, survivor_id (smallest id of all names that hang together), records (of all these
    names). One row per record, also for names that match no other. An id under several names has a
    row for each; it does not join them. Matching stays within blocks, as in `match_names`.

    Pairs of names are not listed. Under each signature all names are first compared with the shortest
    one that offers it, and what matches it is one component. Signatures behind which there is one
    component only are done, however many names they hold; on the others names of different components
    are compared, and what is kept of that is one link per pair of components.
    """
    thresholds = Thresholds(high=least, medium=least)
    groups = staged(name_groups(member_rows).withColumn("node", F.monotonically_increasing_id()), "name-groups")
    offered, sought, near = _meeting(groups, thresholds, skew, direct)

    def scored(pairs: DataFrame) -> DataFrame:
        return _score(pairs.filter(near), thresholds)

    columns = [c for c in offered.columns if c != "sig_a"]
    shortest = offered.groupBy("sig_a").agg(F.min(F.struct("len_a", "name_a", *[
        c for c in columns if c not in ("len_a", "name_a")])).alias("s")).select("sig_a", "s.*")
    to_shortest = salted_join(sought, shortest, ["sig_b"], ["sig_a"], "inner", skew=skew)
    stars = staged(scored(to_shortest).select("node_a", "node_b").distinct(), "name-links")
    found = components(stars, skew=skew)

    def labelled(side: DataFrame, name: str) -> DataFrame:
        own = found.select(F.col("node").alias("of"), F.col("component").alias(f"part_{name}"))
        joined = salted_join(side, own, [f"node_{name}"], ["of"], "left", skew=skew).drop("of")
        return joined.withColumn(f"part_{name}", F.coalesce(f"part_{name}", f"node_{name}"))

    parted_a, parted_b = labelled(offered, "a"), labelled(sought, "b")
    ends = (parted_a.select(F.col("sig_a").alias("sig"), F.col("part_a").alias("part"))
            .unionAll(parted_b.select("sig_b", "part_b"))
            .groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")))
    several = staged(ends.where("low < high").select("sig"), "open-signatures")
    still_open = [staged(parted.join(several.select(F.col("sig").alias(f"sig_{name}")), f"sig_{name}",
                                     "left_semi"), f"open-names-{name}")
                  for parted, name in ((parted_a, "a"), (parted_b, "b"))]
    across = scored(_met(*still_open, skew).where("part_a <> part_b")).select(
        F.col("part_a").alias("node_a"), F.col("part_b").alias("node_b")).distinct()
    whole = components(stars.unionAll(staged(across, "name-links")), skew=skew)

    grouped = groups.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = grouped.groupBy("component").agg(
        F.min("first_id").alias("survivor_id"), F.sum("records").alias("records")).withColumnRenamed(
            "component", "of_component")
    named = salted_join(grouped.drop("records", "first_id"), facts, ["component"], ["of_component"], "inner",
                        skew=skew).select(F.col("block").alias("of_block"), F.col("name").alias("of_name"),
                                          "survivor_id", "records")
    own = member_rows.filter("name IS NOT NULL AND name <> ''").drop("m")
    return salted_join(own, named, ["block", "name"], ["of_block", "of_name"], "inner", skew=skew).drop(
        "of_block", "of_name")
