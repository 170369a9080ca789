"""Column look-up, safe casts and stamps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, also if the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first candidate the table has (names are case-sensitive), or None."""
    present = set(df.columns)
    return next((c for c in candidates if c in present), None)


def require_columns(df: DataFrame, names: Iterable[str], role: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{role} lacks the columns {absent}; it has {df.columns}")


def as_type(df: DataFrame, name: str, type_name: str) -> Column:
    """Column `name` in the wanted type, NULL where the text is malformed.

    A column that already has the type is passed on bare, so filters on it reach the scan.
    """
    if dict(df.dtypes)[name] == type_name:
        return named(name)
    return named(name).try_cast(type_name)


def run_time(moment: dt.datetime | None = None) -> dt.datetime:
    """The one moment a run stamps on all of its outputs."""
    return moment or dt.datetime.now(dt.timezone.utc)


def moment_column(moment: dt.datetime) -> Column:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    utc = moment.astimezone(dt.timezone.utc)
    return F.lit(f"{utc:%Y-%m-%d %H:%M:%S.%f}+00:00").cast("timestamp")


def stamp(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Add constant columns; datetimes become UTC timestamps."""
    return df.withColumns({
        name: moment_column(v) if isinstance(v, dt.datetime) else F.lit(v)
        for name, v in values.items()
    })


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end; each endpoint is floored to whole seconds first."""
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return seconds / F.lit(60.0)


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
