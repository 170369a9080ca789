import datetime as dt

import pytest

from lakewarden.operators.enrich import Dimension, Role, add_duration, add_roles, enrich
from lakewarden.operators.keyed import Skew

ZONES = "LocationID int, Borough string, Zone string, service_zone string"


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([(1, "B1", "Z1", "S1"), (2, "B2", "Z2", "S2"),
                                  (None, "B3", "Z3", "S3")], ZONES)


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame([(1, 1, 2), (2, 9, 1), (3, None, 2)],
                                 "n int, PULocationID int, DOLocationID int")


@pytest.mark.parametrize("limit", [10**9, 0])
def test_both_roles(trips, zones, rows, limit):
    got = add_roles(trips, zones, limit=limit, skew=Skew(rows=1))
    assert rows(got, "n", "pu_zone", "pu_borough", "do_service_zone") == [
        (1, "Z1", "B1", "S2"), (2, None, None, "S1"), (3, None, None, "S2")]
    assert set(got.columns) == {"n", "PULocationID", "DOLocationID", "pu_zone", "pu_borough",
                                "pu_service_zone", "do_zone", "do_borough", "do_service_zone"}


def test_dimension_key_can_be_kept(trips, zones, rows):
    got = add_roles(trips, zones, keep_key_as="location_id")
    assert rows(got, "n", "pu_location_id") == [(1, 1), (2, None), (3, None)]


def test_absent_foreign_key_is_skipped(trips, zones):
    got = add_roles(trips.drop("DOLocationID"), zones)
    assert "do_zone" not in got.columns and "pu_zone" in got.columns


def test_repeated_dimension_key_is_refused(trips, zones):
    with pytest.raises(ValueError, match="not unique"):
        add_roles(trips, zones.union(zones))


def test_small_dimension_is_broadcast(trips, zones):
    plan = add_roles(trips, zones)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_other_names(spark, rows):
    facts = spark.createDataFrame([("a",)], "code string")
    codes = spark.createDataFrame([("a", "Alpha")], "id string, label string")
    got = add_roles(facts, codes, [Role("code", "c")], Dimension("id", {"label": "name"}))
    assert rows(got) == [("a", "Alpha")]


def test_whole_stage(spark, zones):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start, start + dt.timedelta(seconds=90), 1)],
                               "pickup_ts timestamp, dropoff_ts timestamp, PULocationID int")
    row = enrich(df, zones).first()
    assert (row["trip_duration_min"], row["pu_zone"], row["governance_zone"]) == (1.5, "Z1", "curated")
    assert add_duration(df.drop("pickup_ts")).columns == ["dropoff_ts", "PULocationID"]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_dimension_key_read_as_text(spark, trips, rows, limit):
    text = spark.createDataFrame([("1", "B", "Z1", "S"), ("odd", "B", "Z?", "S")],
                                 "LocationID string, Borough string, Zone string,"
                                 " service_zone string")
    got = add_roles(trips, text, limit=limit)
    assert rows(got, "n", "pu_zone", "do_zone") == [(1, "Z1", None), (2, None, "Z1"),
                                                    (3, None, None)]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_text_key_for_foreign_keys_of_two_widths(spark, rows, limit):
    facts = spark.createDataFrame([(1, 1, 3_000_000_000)],
                                  "n int, PULocationID int, DOLocationID bigint")
    text = spark.createDataFrame([("1", "B", "near", "S"), ("3000000000", "B", "far", "S")],
                                 "LocationID string, Borough string, Zone string,"
                                 " service_zone string")
    assert rows(add_roles(facts, text, limit=limit), "pu_zone", "do_zone") == [("near", "far")]
