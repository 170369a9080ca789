"""Orphans, lifecycle counts and the run summary."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import fixed_values as fv
from lakewarden.functions.columns import require_columns, run_time, stamp
from lakewarden.operators.bitmaps import (
    BITMAP_BYTES,
    BUCKET_BYTES,
    bitmaps,
    buckets_of,
    with_membership,
)
from lakewarden.operators.keyed import BROADCAST_BYTES, Skew, common_type, lookup_join, measure
from lakewarden.sources.store import staged

ZONE_LABELS = {fv.START_FK: fv.START_ORPHAN, fv.END_FK: fv.END_ORPHAN}


def known_keys(master: DataFrame, key: str, key_type: T.DataType | str) -> DataFrame:
    """Distinct master keys; text that is no key and NULL are left out."""
    require_columns(master, [key], "master table")
    return master.select(F.col(key).try_cast(key_type).alias(key)).dropna().distinct()


def orphans(fact: DataFrame, master: DataFrame, key: str = fv.ZONE_KEY,
            labels: Mapping[str, str] = ZONE_LABELS, *,
            key_type: T.DataType | str | None = None, key_copies: bool = True,
            limit: int = BROADCAST_BYTES, bitmap_limit: int = BITMAP_BYTES,
            skew: Skew = Skew()) -> DataFrame:
    """Fact rows whose foreign key is not in the master, one row per failing foreign key.

    A NULL foreign key is an orphan. Keys are compared in the common type of the columns, unless
    one is given; integer copies of the foreign keys are columns of the output only. The fact is
    read once, however many foreign keys there are: each is looked up in the key set, and a row is
    repeated per label it earned.

    A key set of up to `limit` bytes is broadcast. A larger one of whole numbers becomes bitmaps, which
    are broadcast up to `bitmap_limit` bytes: the fact is not shuffled then, either. Beyond that both
    sides are shuffled, once for each foreign key.
    """
    require_columns(fact, labels, "fact table")
    require_columns(master, [key], "master table")
    if key_type is None:
        kinds = [fact.schema[fk].dataType for fk in labels]
        key_type = reduce(common_type, kinds, master.schema[key].dataType)
    keys = known_keys(master, key, key_type)
    size = measure(keys, key)
    as_bitmaps = False
    if not size.fits(limit):  # a small set is cheaper to find again than to write
        keys = staged(keys, "known-keys")
        as_bitmaps = (isinstance(keys.schema[key].dataType, T.IntegralType)
                      and buckets_of(keys, key) * BUCKET_BYTES <= bitmap_limit)
    copies = {f"{fk}_int": F.col(fk).try_cast("int") for fk in labels} if key_copies else {}
    typed_names = {fk: f"__fk{i}" for i, fk in enumerate(labels)}
    typed = fact.withColumns(copies | {name: F.col(fk).try_cast(key_type)
                                       for fk, name in typed_names.items()})

    if as_bitmaps:
        sets = staged(bitmaps(keys, key), "key-bitmaps")
        marked, known = typed, [f"__known{i}" for i in range(len(labels))]
        for name, out in zip(typed_names.values(), known, strict=True):
            marked = with_membership(marked, sets, name, out)
        found = _repeated(marked, {label: ~F.col(out) for out, label in zip(
            known, labels.values(), strict=True)}).drop(*known)
    elif len(labels) == 1:
        (fk, label), = labels.items()
        side = keys.select(F.col(key).alias("__known"))
        lost = lookup_join(typed, side, typed_names[fk], "__known", "left_anti",
                           size=size, limit=limit, skew=skew)
        found = lost.withColumn("orphan_type", F.lit(label))
    else:
        marked = typed
        for i, fk in enumerate(labels):
            side = keys.select(F.col(key).alias(f"__known{i}"))
            marked = lookup_join(marked, side, typed_names[fk], f"__known{i}", "left",
                                 size=size, limit=limit, skew=skew)
        known = [f"__known{i}" for i in range(len(labels))]
        found = _repeated(marked, {label: F.col(k).isNull() for k, label in zip(
            known, labels.values(), strict=True)}).drop(*known)
    return found.drop(*typed_names.values())


def _repeated(df: DataFrame, earned: Mapping[str, Column]) -> DataFrame:
    """Each row once per label it earned. Rows without a label go before any is repeated; an array
    of plain conditions is exploded in compiled code, unlike one that a function on arrays made."""
    lost = df.where(reduce(Column.__or__, earned.values()))
    labels = F.array(*[F.when(test, F.lit(label)) for label, test in earned.items()])
    return lost.withColumn("orphan_type", F.explode(labels)).where("orphan_type IS NOT NULL")


def stamp_orphans(found: DataFrame, job_name: str, moment: dt.datetime | None = None) -> DataFrame:
    return stamp(found, {"job_name": job_name, "detected_at_utc": run_time(moment)})


def lifecycle_snapshot(master: DataFrame, states: Iterable[str] | None = None,
                       job_name: str | None = None,
                       moment: dt.datetime | None = None) -> DataFrame:
    """Records per state; with configured states, also whether the state is one of them.

    A table without states counts as all ACTIVE. A NULL state is not valid.
    """
    if "mdm_state" in master.columns:
        counted = master.groupBy("mdm_state").agg(F.count("*").alias("record_count"))
    else:
        counted = (
            master.groupBy(F.lit(fv.STATE_ACTIVE).alias("mdm_state"))
            .agg(F.count("*").alias("record_count"))
        )
    if states is not None:
        valid = F.coalesce(F.col("mdm_state").isin(sorted(states)), F.lit(False))
        counted = counted.select("mdm_state", valid.alias("mdm_state_valid"), "record_count")
    if job_name is None:
        return counted
    return stamp(counted, {"job_name": job_name, "snapshot_at_utc": run_time(moment)})


SUMMARY_SCHEMA = T.StructType([
    T.StructField(name, T.LongType() if name == fv.SUMMARY_COUNT else T.StringType())
    for name in fv.SUMMARY_COLUMNS
])


def run_summary(spark: SparkSession, values: Mapping[str, object],
                moment: dt.datetime | None = None) -> DataFrame:
    """One row that says what the run read, wrote and found."""
    row = tuple(values[name] for name in SUMMARY_SCHEMA.names)
    return stamp(spark.createDataFrame([row], SUMMARY_SCHEMA),
                 {"generated_at_utc": run_time(moment)})
