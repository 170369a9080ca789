"""Joins on one key that hold up when a single key owns a large share of the rows.

A side is broadcast only after its size was measured. Otherwise both sides are shuffled, and
the heaviest keys are split over as many partitions as their rows call for: a row of a heavy
key gets a salt computed from its own content (so a recomputed task gives the same answer), and
the other side repeats its rows for that key once per salt. Only heavy keys are repeated. Their
list holds a hash and a number, 12 bytes, for each of them, and a key is heavy only from
HEAVY_ROWS rows on: so its broadcast takes 12 bytes for every million rows of the table at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.columns import named

BROADCAST_BYTES = 32 * 1024 * 1024
HEAVY_ROWS = 1_000_000

_HEAVY = "__heavy"
_SALTS = "__salts"
_HASH = "__hash"
_SALT = "__salt"
_SIDE_SALT = "__side_salt"
_LEFT_KEY = "__left_key"
_RIGHT_KEY = "__right_key"


@dataclass(frozen=True)
class SideSize:
    """What one pass over a join side found."""

    rows: int
    bytes: int
    largest_key: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit


@dataclass(frozen=True)
class Skew:
    """A key with this many rows is heavy and gets one salt per so many rows."""

    rows: int = HEAVY_ROWS


def _width(df: DataFrame) -> Column:
    """Bytes of a row in memory, roughly: 16 for the row, 8 per field, plus the text."""
    fixed = F.lit(16 + 8 * len(df.columns)).cast("long")
    texts = [
        F.coalesce(F.octet_length(named(f.name).cast("string")), F.lit(0))
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType,
                                       T.TimestampType, T.TimestampNTZType))
    ]
    return sum(texts, fixed)


def measure(side: DataFrame, key: str) -> SideSize:
    """Rows, bytes and the largest number of rows per non-NULL key, in one aggregation."""
    per_key = side.groupBy(key).agg(F.count("*").alias("n"), F.sum(_width(side)).alias("b"))
    found = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("b"),
        F.coalesce(F.max(F.when(F.col(key).isNotNull(), F.col("n"))), F.lit(0)).alias("k"),
    ).first()
    return SideSize(found["n"], found["b"], found["k"])


def require_unique(size: SideSize, key: str) -> None:
    if size.largest_key > 1:
        raise ValueError(
            f"{key} is not unique: one value has {size.largest_key} rows, "
            "so a look-up would repeat rows of the other side"
        )


def _matches(left: Sequence[str], right: Sequence[str], null_safe: bool) -> Column:
    tests = [
        F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
        for a, b in zip(left, right, strict=True)
    ]
    joined = tests[0]
    for test in tests[1:]:
        joined = joined & test
    return joined


def _content_hash(df: DataFrame) -> Column:
    """Hash of a row; maps are left out because Spark does not hash them."""
    names = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[named(n) for n in names])


def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys have equal hashes on both sides. Whole numbers hash alike in all widths."""
    return F.xxhash64(*[
        F.col(k).cast("bigint") if isinstance(df.schema[k].dataType, T.IntegralType) else F.col(k)
        for k in keys
    ])


def _hash_kinds(df: DataFrame, keys: Sequence[str]) -> list[str]:
    kinds = (df.schema[k].dataType for k in keys)
    return ["integer" if isinstance(k, T.IntegralType) else k.simpleString() for k in kinds]


def heavy_keys(counts: DataFrame, n: str, skew: Skew) -> DataFrame:
    """The keys with skew.rows rows or more, by hash, with their number of salts.

    Two keys with one hash are both treated as heavy, on both sides alike, which is harmless.
    """
    keys = [c for c in counts.columns if c != n]
    return (
        counts.filter(F.col(n) >= skew.rows)
        .select(_key_hash(counts, keys).alias(_HEAVY), F.col(n))
        .groupBy(_HEAVY).agg(F.max(n).alias(n))
        .select(_HEAVY, (F.floor(F.col(n) / skew.rows) + 1).cast("int").alias(_SALTS))
    )


def salted_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                right_keys: Sequence[str], how: str, *, heavy: DataFrame | None = None,
                null_safe: bool = False, skew: Skew = Skew()) -> DataFrame:
    """Shuffle join; `how` is left, inner or left_anti. Left may be skewed, right repeats.

    All column names of the two sides must differ; keys must have the same types. Rows without
    a key are one more key here, so many of them are spread as well.
    """
    if _hash_kinds(left, left_keys) != _hash_kinds(right, right_keys):
        raise ValueError(
            f"keys differ in type: {_hash_kinds(left, left_keys)} for {list(left_keys)}, "
            f"{_hash_kinds(right, right_keys)} for {list(right_keys)}")
    if heavy is None:
        counts = left.groupBy(*left_keys).agg(F.count("*").alias("__n"))
        heavy = heavy_keys(counts, "__n", skew)
    small = F.broadcast(heavy)  # 12 bytes per skew.rows rows of the table at most

    def marked(side: DataFrame, keys: Sequence[str]) -> DataFrame:
        hashed = side.withColumn(_HASH, _key_hash(side, keys))
        return hashed.join(small, F.col(_HASH) == F.col(_HEAVY), "left")

    salt = F.pmod(_content_hash(left), F.col(_SALTS)).cast("int")
    salted_left = marked(left, left_keys).withColumn(
        _SALT, F.coalesce(salt, F.lit(0))).drop(_HASH, _HEAVY, _SALTS)
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    salted_right = marked(right, right_keys).withColumn(
        _SIDE_SALT, F.explode(copies)).drop(_HASH, _HEAVY, _SALTS)
    same_salt = F.col(_SALT) == F.col(_SIDE_SALT)
    joined = salted_left.join(
        salted_right, _matches(left_keys, right_keys, null_safe) & same_salt, how,
    )
    return joined.drop(_SALT, _SIDE_SALT)


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which two keys are compared, whatever way the join takes.

    Whole numbers are compared as 64-bit ones, other mixtures of numbers in the type Spark widens
    them to, and text with any other type in that type (text that is no such value matches
    nothing). Other unlike types are compared as text.
    """
    if left == right:
        return left
    whole = isinstance(left, T.IntegralType), isinstance(right, T.IntegralType)
    if all(whole):
        return T.LongType()
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        decimals = [t for t in (left, right) if isinstance(t, T.DecimalType)]
        if not decimals or len(decimals) + sum(whole) < 2:
            return T.DoubleType()
        scale = max(t.scale for t in decimals)
        return T.DecimalType(38, min(scale, 18))
    for text, other in ((left, right), (right, left)):
        if isinstance(text, T.StringType):
            return T.LongType() if isinstance(other, T.IntegralType) else other
    return T.StringType()


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, *,
                size: SideSize | None = None, limit: int = BROADCAST_BYTES,
                skew: Skew = Skew()) -> DataFrame:
    """Join to a look-up table: broadcast if its measured size allows, else salted shuffle.

    Keys of unlike types are brought to their common type before that choice.
    """
    size = size or measure(right, right_key)
    kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
    helpers: list[str] = []
    if kinds[0] != kinds[1]:
        common = common_type(*kinds)
        left = left.withColumn(_LEFT_KEY, F.col(left_key).try_cast(common))
        right = right.withColumn(_RIGHT_KEY, F.col(right_key).try_cast(common))
        left_key, right_key, helpers = _LEFT_KEY, _RIGHT_KEY, [_LEFT_KEY, _RIGHT_KEY]
    if size.fits(limit):
        joined = left.join(F.broadcast(right), F.col(left_key) == F.col(right_key), how)
    else:
        joined = salted_join(left, right, [left_key], [right_key], how, skew=skew)
    return joined.drop(*helpers)


def with_group_size(df: DataFrame, keys: Sequence[str], out: str, *,
                    skew: Skew = Skew()) -> DataFrame:
    """Add the number of rows that share the keys (NULL keys form a group of their own).

    Same result as a count over a window, but no group is ever gathered: sizes are counted with
    map-side partial sums and joined back.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias(out))
    heavy = heavy_keys(counts, out, skew)
    sides = [f"__g{i}" for i in range(len(keys))]
    right = counts.select(*[F.col(k).alias(s) for k, s in zip(keys, sides, strict=True)], out)
    joined = salted_join(df, right, keys, sides, "inner", heavy=heavy, null_safe=True, skew=skew)
    return joined.drop(*sides)
