"""Matching by a configured key: records that share the key are one group."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import MatchConfig, Thresholds
from lakewarden.functions.columns import run_time, stamp
from lakewarden.functions.matching import decision, group_confidence
from lakewarden.operators.golden import golden_master
from lakewarden.operators.keyed import Skew, with_group_size


def match_exact(records: DataFrame, config: MatchConfig, *, skew: Skew = Skew()) -> DataFrame:
    """Add match key, group size, confidence and decision to every record."""
    keyed = records.withColumn("match_key", F.expr(config.key_sql))
    sized = with_group_size(keyed, ["match_key"], "dupe_count", skew=skew)
    scored = sized.withColumn("match_confidence", group_confidence(F.col("dupe_count")))
    return scored.withColumn(
        "decision", decision(F.col("match_confidence"), config.thresholds))


def _having(scored: DataFrame, wanted: str) -> DataFrame:
    return scored.filter(F.col("decision") == wanted)


def exact_master(scored: DataFrame, id_column: str, *,
                 moment: dt.datetime | None = None) -> DataFrame:
    """Survivors among the records that merge without review."""
    return golden_master(_having(scored, fv.AUTO_MERGE), ["match_key"], id_column,
                         source=fv.MASTER_SOURCE, moment=moment)


def review_records(scored: DataFrame, *, moment: dt.datetime | None = None) -> DataFrame:
    return stamp(_having(scored, fv.STEWARD_REVIEW), {
        "mdm_state": fv.STATE_PROPOSED,
        "submitted_at_utc": run_time(moment),
        "submitted_by": fv.SUBMITTED_BY,
        "review_reason": fv.REVIEW_REASON,
    })


def rejected_records(scored: DataFrame, *, moment: dt.datetime | None = None) -> DataFrame:
    return stamp(_having(scored, fv.REJECT), {
        "mdm_state": fv.STATE_REJECTED,
        "rejected_at_utc": run_time(moment),
        "reject_reason": fv.REJECT_REASON,
    })


def exact_audit(scored: DataFrame, thresholds: Thresholds,
                lineage: Mapping[str, object] | None = None) -> DataFrame:
    """One row: records per decision, average confidence, thresholds and lineage."""
    counted = scored.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("decision") == fv.AUTO_MERGE).alias("auto_merge_rows"),
        F.count_if(F.col("decision") == fv.STEWARD_REVIEW).alias("steward_review_rows"),
        F.count_if(F.col("decision") == fv.REJECT).alias("reject_rows"),
        F.avg("match_confidence").alias("avg_match_confidence"),
    )
    return stamp(counted, {
        "high_conf_threshold": thresholds.high,
        "med_conf_threshold": thresholds.medium,
        **(lineage or {}),
    })
