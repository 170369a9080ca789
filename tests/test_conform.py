import datetime as dt

import pytest

from lakewarden.config import Contract
from lakewarden.operators.conform import (
    POSITIVE_FARE_PLAN,
    ConformPlan,
    align_types,
    conform,
    fix_names,
    gate,
    standard_times,
)

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def trips(spark, data, more=""):
    return spark.createDataFrame(
        data, f"n int, pickup_datetime timestamp, dropoff_datetime timestamp{more}")


def kept(df):
    return sorted(r["n"] for r in df.collect())


def test_times_must_exist_and_be_in_order(spark):
    second = dt.timedelta(seconds=1)
    df = trips(spark, [(1, None, T0), (2, T0, None), (3, T0, T0), (4, T0, T0 - second),
                       (5, T0, T0 + second)])
    assert kept(conform(df)) == [3, 5]


@pytest.mark.parametrize("plan, expected", [(ConformPlan(), [1]), (POSITIVE_FARE_PLAN, [])])
def test_fare_gates(spark, plan, expected):
    df = trips(spark, [(1, T0, T0, 0.0), (2, T0, T0, -0.01), (3, T0, T0, None)],
               ", fare_amount double")
    assert kept(conform(df, plan=plan)) == expected


def test_measures_given_as_text_are_gated(spark):
    df = trips(spark, [(1, T0, T0, "3.5"), (2, T0, T0, "x"), (3, T0, T0, "-1")],
               ", total_amount string")
    assert kept(conform(df)) == [1]


def test_contract_casts_what_it_can(spark):
    df = spark.createDataFrame([("1", "x", "7"), ("y", "2.5", "8")], "a string, b string, c string")
    got = align_types(df, Contract(types={"a": "int", "b": "double", "absent": "int"}))
    assert got.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    assert [tuple(r) for r in got.collect()] == [(1, None, "7"), (None, 2.5, "8")]


def test_renamed_column_meets_its_contract(spark):
    df = trips(spark, [(1, T0, T0, "1.5")], ", Airport_fee string")
    got = conform(df, Contract(types={"airport_fee": "double"}))
    assert dict(got.dtypes)["airport_fee"] == "double" and "Airport_fee" not in got.columns


def test_both_spellings_are_refused(spark):
    df = spark.sql("SELECT 1 AS Airport_fee, 2 AS airport_fee")
    with pytest.raises(ValueError, match="Airport_fee"):
        fix_names(df, {"Airport_fee": "airport_fee"})


def test_candidate_order_and_missing_times(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS lpep_pickup_datetime,"
                   " timestamp'2024-01-02' AS pickup_datetime,"
                   " timestamp'2024-01-03' AS dropoff_datetime")
    assert standard_times(df).first()["pickup_date"] == dt.date(2024, 1, 1)
    with pytest.raises(ValueError, match="no start"):
        standard_times(df.drop("dropoff_datetime"))


def test_other_columns_pass_whatever_their_names(spark):
    got = conform(trips(spark, [(1, T0, T0, 5)], ", `odd.name` int"))
    assert "odd.name" in got.columns and got.count() == 1


def test_stamps_and_defaults(spark):
    moment = dt.datetime(2024, 2, 3, tzinfo=dt.timezone.utc)
    row = conform(trips(spark, [(1, T0, T0)]), moment=moment).first().asDict()
    assert (row["governance_zone"], row["source_system"], row["dataset_name"],
            row["classification"]) == ("validated", "NYC_TLC", "unknown_dataset", "unknown")


def test_gate_reaches_the_scan(spark, tmp_path, plan_text):
    path = str(tmp_path / "t")
    trips(spark, [(1, T0, T0, 1.0)], ", fare_amount double").write.parquet(path)
    read = standard_times(spark.read.parquet(path))
    plan = plan_text(gate(read).select("n"))
    assert "GreaterThanOrEqual(fare_amount,0.0)" in plan and "Exchange" not in plan
