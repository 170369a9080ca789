"""Quality rules: flags, pass/quarantine split, report and pass-rate gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import QualityPolicy, Rule
from lakewarden.functions.columns import named, pick_column, share_of, stamp

PASS = "dq_pass"
FAILED = "failed_rules"


class QualityBelowThreshold(RuntimeError):
    """The share of good rows is under the policy's minimum."""


@dataclass(frozen=True)
class AutoRules:
    """What to check when a column of that name is present. Rules use plain SQL conditions."""

    not_null: Mapping[str, str] = field(default_factory=lambda: dict(fv.NOT_NULL_RULES))
    start_candidates: Sequence[str] = fv.QUALITY_START_COLUMNS
    end_candidates: Sequence[str] = fv.QUALITY_END_COLUMNS
    start_rule: str = fv.START_RULE
    end_rule: str = fv.END_RULE
    order_rule: str = fv.ORDER_RULE
    non_negative: Sequence[str] = fv.QUALITY_NON_NEGATIVE
    ranges: Mapping[str, tuple[str, int, int]] = field(
        default_factory=lambda: dict(fv.RANGE_RULES))


def derive_rules(df: DataFrame, auto: AutoRules = AutoRules()) -> list[Rule]:
    """Rules for the columns the table has. Measures and codes may be NULL, keys may not.

    Text columns are read as numbers or times where possible; other text fails the rule.
    """
    types = dict(df.dtypes)

    def number(c: str) -> str:
        return f"try_cast(`{c}` AS double)" if types[c] == "string" else f"`{c}`"

    def time(c: str) -> str:
        return f"try_cast(`{c}` AS timestamp)"

    rules = [
        Rule(name, f"`{c}` IS NOT NULL") for c, name in auto.not_null.items() if c in df.columns
    ]
    start, end = pick_column(df, auto.start_candidates), pick_column(df, auto.end_candidates)
    if start:
        rules.append(Rule(auto.start_rule, f"`{start}` IS NOT NULL"))
    if end:
        rules.append(Rule(auto.end_rule, f"`{end}` IS NOT NULL"))
    if start and end:
        rules.append(Rule(auto.order_rule, f"{time(start)} <= {time(end)}"))
    for c in auto.non_negative:
        if c in df.columns:
            rules.append(Rule(f"{c}{fv.NON_NEGATIVE_RULE}", f"`{c}` IS NULL OR {number(c)} >= 0"))
    for c, (name, low, high) in auto.ranges.items():
        if c in df.columns:
            test = f"`{c}` IS NULL OR {number(c)} BETWEEN {low} AND {high}"
            rules.append(Rule(name, test))
    return rules


def _all_of(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [named(n) for n in names], F.lit(True))


def add_flags(df: DataFrame, rules: Sequence[Rule], *, null_as_pass: bool = False,
              list_failed: bool = True) -> DataFrame:
    """One boolean per rule, `dq_pass`, and the names of the failed rules.

    Rules cannot replace columns, so all see the row as it came in; a rule may also use the flag
    of an earlier one. A rule that yields NULL fails (or passes, on request), so each row either
    passes or is quarantined.
    """
    names = [r.name for r in rules]
    taken = {c.lower() for c in df.columns}
    clashes = [n for n in (*names, PASS, FAILED) if n.lower() in taken]
    if clashes:
        raise ValueError(f"these names are already columns of the table: {clashes}")
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"rule names must differ in more than case: {names}")
    flags = [F.coalesce(F.expr(r.sql), F.lit(null_as_pass)).alias(r.name) for r in rules]
    flagged = df.select("*", *flags).withColumn(PASS, _all_of(names))
    if not list_failed:
        return flagged
    failed = [F.when(~named(n), F.lit(n)) for n in names]
    listed = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return flagged.withColumn(FAILED, listed)


def passed(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(PASS)).drop(PASS)


def quarantined(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col(PASS))


def _fail_counts(rules: Sequence[Rule]) -> list[Column]:
    return [F.count_if(~named(r.name)).alias(f"{r.name}_fail_count") for r in rules]


def report(flagged: DataFrame, rules: Sequence[Rule],
           lineage: Mapping[str, object] | None = None) -> DataFrame:
    """One row: totals, pass rate and failures per rule, from a single aggregation."""
    counted = flagged.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(PASS)).alias("passed_rows"),
        F.count_if(~F.col(PASS)).alias("failed_rows"),
        *_fail_counts(rules),
    )
    rated = counted.withColumn("pass_rate", share_of(F.col("passed_rows"), F.col("total_rows")))
    return stamp(rated, lineage or {})


def report_of_outputs(pass_table: DataFrame, quarantine_table: DataFrame, rules: Sequence[Rule],
                      lineage: Mapping[str, object] | None = None) -> DataFrame:
    """The same report from the two written tables.

    Reads row counts and boolean flags only, and describes what is really stored; counters
    collected during a write could count a re-run task twice.
    """
    flags = [named(r.name) for r in rules]
    both = pass_table.select(F.lit(True).alias(PASS), *flags).unionByName(
        quarantine_table.select(PASS, *flags))
    return report(both, rules, lineage)


def fail_counts_long(flagged: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: how many rows were checked and how many failed."""
    counted = flagged.agg(F.count("*").alias("checked_rows"), *_fail_counts(rules))
    entries = F.array(*[
        F.struct(F.lit(r.name).alias("rule_id"), F.col("checked_rows"),
                 named(f"{r.name}_fail_count").alias("fail_count"))
        for r in rules
    ])
    return counted.select(F.inline(entries))


def enforce(pass_rate: float, policy: QualityPolicy, where: str = "") -> None:
    """Raise if the rate is below the minimum; a rate equal to it is fine."""
    if policy.fail_below and pass_rate < policy.min_pass_rate:
        raise QualityBelowThreshold(
            f"pass rate {pass_rate:.4f} is below the minimum {policy.min_pass_rate:.4f}. {where}"
            .strip()
        )
