"""Survivors, duplicate evidence and the record-level outputs of matching."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import fixed_values as fv
from lakewarden.functions.columns import named, run_time, stamp

_RANK = "__rank"


def survivors(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """The row with the smallest id per key; rows that share that id are told apart by content.

    Spark keeps only the best row per key in every map task before it shuffles (window group
    limit), so a key with very many rows sends one row per task to its partition.
    """
    ties = [
        named(f.name) for f in df.schema.fields
        if f.name not in keys and f.name != id_column
        and isinstance(f.dataType, T.AtomicType)
    ]
    best_first = Window.partitionBy(*keys).orderBy(F.asc(id_column), *ties)
    ranked = df.withColumn(_RANK, F.row_number().over(best_first))
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def golden_master(df: DataFrame, keys: Sequence[str], id_column: str, *,
                  source: str | None = None, moment: dt.datetime | None = None) -> DataFrame:
    """One ACTIVE row per key, stamped with its times and the survivorship rule."""
    moment = run_time(moment)
    stamps = {"mdm_state": fv.STATE_ACTIVE, "created_at_utc": moment, "updated_at_utc": moment}
    if source is not None:
        stamps["source_system"] = source
    stamps["survivorship_rule"] = f"min({id_column}) per {', '.join(keys)}"
    return stamp(survivors(df, keys, id_column), stamps)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter(F.col("count") > 1)
