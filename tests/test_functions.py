import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewarden.config import Thresholds
from lakewarden.functions.columns import as_type, minutes_between, pick_column, stamp
from lakewarden.functions.matching import (
    composite_key,
    decision,
    edit_similarity,
    first_token,
    group_confidence,
    normalized,
    pair_confidence,
    token_agreement,
)


def test_normalized_name(spark, rows):
    df = spark.createDataFrame([("Café  de l'Ouest-2",), ("",), (None,), ("  a\tb ",)], "t string")
    got = rows(df.select("t", normalized(F.col("t")).alias("n")))
    assert ("Café  de l'Ouest-2", "CAF DE L OUEST 2") in got
    assert ("", "") in got and (None, None) in got and ("  a\tb ", "A B") in got


def _confidence(df):
    a, b = F.col("a"), F.col("b")
    return df.withColumn("sim", edit_similarity(a, b)).withColumn(
        "tok", token_agreement(first_token(a), first_token(b))).withColumn(
        "conf", pair_confidence(F.col("sim"), F.col("tok"))).withColumn(
        "d", decision(F.col("conf"), Thresholds()))


def test_empty_and_missing_names_are_rejected(spark, rows):
    df = spark.createDataFrame([("", ""), ("A", None), ("AB CD", "AB CE")], "a string, b string")
    got = {r["b"]: (r["sim"], r["tok"], r["conf"], r["d"]) for r in _confidence(df).collect()}
    assert got[""] == (0.0, 1.0, 0.1, "REJECT")
    assert got[None] == (None, 0.0, None, "REJECT")
    assert got["AB CE"] == (0.8, 1.0, 0.82, "STEWARD_REVIEW")


def test_decision_steps_are_inclusive(spark):
    df = spark.createDataFrame([(0.95,), (0.80,), (0.7999,), (None,)], "c double")
    got = [r["d"] for r in df.select(decision(F.col("c"), Thresholds()).alias("d")).collect()]
    assert got == ["AUTO_MERGE", "STEWARD_REVIEW", "REJECT", "REJECT"]


def test_group_confidence(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "n int")
    assert [r[0] for r in df.select(group_confidence(F.col("n"))).collect()] == [0.99, 0.88, 0.88]


def test_key_skips_missing_parts(spark):
    df = spark.createDataFrame([(None, "ZONE"), ("B", "Z")], "b string, z string")
    got = [r[0] for r in df.select(composite_key(F.col("b"), F.col("z"))).collect()]
    assert got == ["ZONE", "B::Z"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_minutes_floor_each_endpoint(spark, kind):
    df = spark.sql(f"SELECT CAST('2024-01-01 00:00:00.2' AS {kind}) a,"
                   f" CAST('2024-01-01 00:01:30.9' AS {kind}) b,"
                   f" CAST('1969-12-31 23:59:59.5' AS {kind}) c")
    got = df.select(minutes_between(F.col("a"), F.col("b")),
                    minutes_between(F.col("c"), F.col("c"))).first()
    assert tuple(got) == (1.5, 0.0)


def test_pick_column_keeps_order_and_case(spark):
    df = spark.createDataFrame([(1, 2)], "B int, a int")
    assert pick_column(df, ["x", "a", "B"]) == "a"
    assert pick_column(df, ["b"]) is None


def test_as_type_yields_null_for_malformed_text(spark):
    df = spark.createDataFrame([("12",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(as_type(df, "t", "int")).collect()] == [12, None, None]


def test_stamp_pins_one_utc_moment(spark):
    moment = dt.datetime(2024, 5, 1, 12, 30, tzinfo=dt.timezone.utc)
    got = stamp(spark.range(2), {"at": moment, "by": "me"})
    assert got.dtypes[1:] == [("at", "timestamp"), ("by", "string")]
    assert {r[0] for r in got.select(F.unix_seconds("at")).collect()} == {int(moment.timestamp())}
