"""Raw to validated: declared types, standard event columns, gates and stamps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import Contract
from lakewarden.functions.columns import as_type, named, pick_column, run_time, stamp


@dataclass(frozen=True)
class ConformPlan:
    """Which columns play which part, and which gates apply."""

    start_candidates: Sequence[str] = fv.CONFORM_START_COLUMNS
    end_candidates: Sequence[str] = fv.CONFORM_END_COLUMNS
    at_least_zero: Sequence[str] = fv.CONFORM_NON_NEGATIVE
    above_zero: Sequence[str] = ()
    renames: Mapping[str, str] = field(default_factory=lambda: dict(fv.RENAMES))
    start_name: str = fv.START_TS
    end_name: str = fv.END_TS
    date_name: str = fv.START_DATE


# The stand-alone variant: only the fare is gated, and zero fares fail.
POSITIVE_FARE_PLAN = ConformPlan(at_least_zero=(), above_zero=fv.CONFORM_POSITIVE)


def fix_names(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Apply known spelling fixes. Runs before the casts, so a fixed name meets its contract."""
    for found, wanted in renames.items():
        if found in df.columns and wanted in df.columns:
            raise ValueError(f"both {found} and {wanted} are present; which one is meant?")
    return df.withColumnsRenamed({f: w for f, w in renames.items() if f in df.columns})


def align_types(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast contracted columns that exist; other columns stay as they are."""
    return df.select([
        as_type(df, c, contract.types[c]).alias(c) if c in contract.types else named(c)
        for c in df.columns
    ])


def standard_times(df: DataFrame, plan: ConformPlan = ConformPlan()) -> DataFrame:
    """Add start, end and start date under their standard names."""
    start = pick_column(df, plan.start_candidates)
    end = pick_column(df, plan.end_candidates)
    if start is None or end is None:
        raise ValueError(
            f"no start among {list(plan.start_candidates)} or no end among "
            f"{list(plan.end_candidates)}; the table has {df.columns}"
        )
    timed = df.withColumns({
        plan.start_name: as_type(df, start, "timestamp"),
        plan.end_name: as_type(df, end, "timestamp"),
    })
    return timed.withColumn(plan.date_name, F.to_date(plan.start_name))


def gate(df: DataFrame, plan: ConformPlan = ConformPlan()) -> DataFrame:
    """Drop rows without both times, rows that end before they start, and bad measures.

    A NULL measure fails its gate.
    """
    start, end = F.col(plan.start_name), F.col(plan.end_name)
    kept = df.filter(start.isNotNull() & end.isNotNull() & (end >= start))
    for names, test in ((plan.at_least_zero, ">="), (plan.above_zero, ">")):
        for name in names:
            if name in df.columns:
                value = as_type(df, name, "double")
                kept = kept.filter(value >= 0.0 if test == ">=" else value > 0.0)
    return kept


def conform(df: DataFrame, contract: Contract = Contract(), plan: ConformPlan = ConformPlan(), *,
            moment: dt.datetime | None = None) -> DataFrame:
    """The whole stage. Narrow: no shuffle between the scan and the result."""
    typed = align_types(fix_names(df, plan.renames), contract)
    return stamp(gate(standard_times(typed, plan), plan), {
        "governance_zone": fv.ZONE_VALIDATED,
        "ingested_at": run_time(moment),
        "source_system": contract.source,
        "dataset_name": contract.dataset_name,
        "classification": contract.classification,
    })
