"""Exact sets of whole numbers as bitmaps, so that a look-up needs no shuffle of the looked-up side.

Spark's bitmap functions put 32,768 neighbouring numbers into one bucket, whose 4 KB say which of them
are in the set. A dense key of a billion values is 32,768 buckets. For the look-up a bucket is an
array of bytes, 8 KB; buckets are broadcast only where their counted number keeps that within a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 8 << 10
BITMAP_BYTES = 256 << 20
_BYTES_IN_BUCKET = 4096


def buckets_of(keys: DataFrame, key: str) -> int:
    """How many buckets the keys fall into; one aggregation."""
    numbers = keys.select(F.bitmap_bucket_number(F.col(key).cast("bigint")).alias("b")).dropna().distinct()
    return numbers.count()


def bitmaps(keys: DataFrame, key: str) -> DataFrame:
    """bucket, members: bit p % 8 of byte p / 8 of a bucket's members is set if number p of it is in the set.

    NULL keys are left out.
    """
    number = F.col(key).cast("bigint")
    byte = "CAST(conv(hex(substring(bits, i + 1, 1)), 16, 10) AS SMALLINT)"
    return (keys.where(number.isNotNull())
            .groupBy(F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
            .select("bucket", F.expr(f"transform(sequence(0, {_BYTES_IN_BUCKET} - 1), i -> {byte})").alias("members")))


def with_membership(df: DataFrame, sets: DataFrame, column: str, out: str) -> DataFrame:
    """Add whether the column's number is in the set; a NULL is not."""
    bucket, members = f"__bucket_{out}", f"__members_{out}"
    number = F.col(column).cast("bigint")
    place = F.bitmap_bit_position(number)
    side = sets.select(F.col("bucket").alias(bucket), F.col("members").alias(members))
    joined = df.join(F.broadcast(side), F.bitmap_bucket_number(number) == F.col(bucket), "left")
    found: Column = F.getbit(F.get(members, F.floor(place / 8).cast("int")), (place % 8).cast("int")) == 1
    return joined.withColumn(out, F.coalesce(found, F.lit(False))).drop(bucket, members)
