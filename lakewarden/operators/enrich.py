"""Validated to curated: durations and the same dimension looked up in several roles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import fixed_values as fv
from lakewarden.functions.columns import minutes_between, require_columns, run_time, stamp
from lakewarden.operators.keyed import (
    BROADCAST_BYTES,
    SideSize,
    Skew,
    common_type,
    lookup_join,
    measure,
    require_unique,
)


@dataclass(frozen=True)
class Role:
    """One use of the dimension: the fact's foreign key and the prefix of the new columns."""

    foreign_key: str
    prefix: str


@dataclass(frozen=True)
class Dimension:
    """Dimension key and the attributes to bring over: attribute -> name after the prefix."""

    key: str = fv.ZONE_KEY
    attributes: Mapping[str, str] = None

    def __post_init__(self):
        if self.attributes is None:
            object.__setattr__(self, "attributes", {
                fv.ZONE_NAME: "zone", fv.ZONE_AREA: "borough", fv.ZONE_SERVICE: "service_zone",
            })


ZONE_ROLES = (Role(fv.START_FK, fv.START_ROLE), Role(fv.END_FK, fv.END_ROLE))


def add_duration(df: DataFrame, start: str = fv.START_TS, end: str = fv.END_TS,
                 out: str = fv.DURATION_MIN) -> DataFrame:
    if start in df.columns and end in df.columns:
        return df.withColumn(out, minutes_between(F.col(start), F.col(end)))
    return df


def _needed(fact: DataFrame, dimension_rows: DataFrame, roles: Sequence[Role],
            dimension: Dimension) -> DataFrame:
    require_columns(dimension_rows, [dimension.key, *dimension.attributes], "dimension")
    # Keys read as text are brought to the common type of all foreign keys; text that is no key
    # drops out.
    key = F.col(dimension.key)
    if dimension_rows.schema[dimension.key].dataType == T.StringType():
        kinds = [fact.schema[r.foreign_key].dataType for r in roles]
        key = key.try_cast(reduce(common_type, kinds))
    keyed = dimension_rows.select(key.alias(dimension.key), *dimension.attributes)
    return keyed.filter(F.col(dimension.key).isNotNull())


def _present(fact: DataFrame, roles: Sequence[Role]) -> list[Role]:
    return [r for r in roles if r.foreign_key in fact.columns]


def dimension_size(fact: DataFrame, dimension_rows: DataFrame,
                   roles: Sequence[Role] = ZONE_ROLES,
                   dimension: Dimension = Dimension()) -> SideSize | None:
    """Measure the dimension and insist on a unique key; None if the fact uses no role."""
    present = _present(fact, roles)
    if not present:
        return None
    size = measure(_needed(fact, dimension_rows, present, dimension), dimension.key)
    require_unique(size, dimension.key)
    return size


def add_roles(fact: DataFrame, dimension_rows: DataFrame, roles: Sequence[Role] = ZONE_ROLES,
              dimension: Dimension = Dimension(), *, keep_key_as: str | None = None,
              size: SideSize | None = None, limit: int = BROADCAST_BYTES,
              skew: Skew = Skew()) -> DataFrame:
    """Left look-up per role; a foreign key without a dimension row gives NULL attributes.

    The dimension is measured once, unless its size is given: its key must be unique, and its
    size decides how the joins run. `keep_key_as` also keeps the matched dimension key, as
    `{prefix}_{keep_key_as}`.
    """
    present = _present(fact, roles)
    if not present:
        return fact
    size = size or dimension_size(fact, dimension_rows, roles, dimension)
    needed = _needed(fact, dimension_rows, present, dimension)
    for role in present:
        side_key = f"{role.prefix}_{keep_key_as}" if keep_key_as else f"__{role.prefix}_key"
        side = needed.select(
            F.col(dimension.key).alias(side_key),
            *[F.col(a).alias(f"{role.prefix}_{n}") for a, n in dimension.attributes.items()],
        )
        fact = lookup_join(fact, side, role.foreign_key, side_key, "left",
                           size=size, limit=limit, skew=skew)
        if not keep_key_as:
            fact = fact.drop(side_key)
    return fact


def enrich(validated: DataFrame, dimension_rows: DataFrame, roles: Sequence[Role] = ZONE_ROLES,
           dimension: Dimension = Dimension(), *, keep_key_as: str | None = None,
           size: SideSize | None = None, moment: dt.datetime | None = None) -> DataFrame:
    """The whole stage: duration, look-ups, stamps."""
    timed = add_duration(validated)
    wide = add_roles(timed, dimension_rows, roles, dimension, keep_key_as=keep_key_as, size=size)
    return stamp(wide, {"governance_zone": fv.ZONE_CURATED, "curated_at": run_time(moment)})
