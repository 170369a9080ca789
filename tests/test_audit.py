import pytest

from lakewarden.operators.audit import (
    lifecycle_snapshot,
    orphans,
    run_summary,
    stamp_orphans,
)
from lakewarden.operators.keyed import Skew


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([("1",), ("2",), ("2",), ("x",), (None,)], "LocationID string")


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame([(1, 1, 2), (2, 9, 1), (3, None, 2), (4, 8, 8), (5, 2, None)],
                                 "n int, PULocationID int, DOLocationID int")


EXPECTED = [(2, "PICKUP_NOT_IN_MASTER"), (3, "PICKUP_NOT_IN_MASTER"),
            (4, "DROPOFF_NOT_IN_MASTER"), (4, "PICKUP_NOT_IN_MASTER"),
            (5, "DROPOFF_NOT_IN_MASTER")]


# Broadcast keys, broadcast bitmaps, and a shuffle of both sides.
LIMITS = [{"limit": 10**9}, {"limit": 0}, {"limit": 0, "bitmap_limit": 0}]


@pytest.mark.parametrize("limits", LIMITS)
def test_one_row_per_failing_key(trips, master, rows, limits):
    got = orphans(trips, master, skew=Skew(rows=2), **limits)
    assert rows(got, "n", "orphan_type") == EXPECTED
    assert set(got.columns) == {"n", "PULocationID", "DOLocationID", "PULocationID_int",
                                "DOLocationID_int", "orphan_type"}


@pytest.mark.parametrize("limits", LIMITS)
def test_total_is_the_sum_of_anti_joins(trips, master, limits):
    each = [orphans(trips, master, labels={fk: fk}, **limits).count()
            for fk in ("PULocationID", "DOLocationID")]
    assert sum(each) == orphans(trips, master, **limits).count() == 5


EDGES = [0, 1, -1, 7, 8, 32_767, 32_768, 32_769, 65_536, 65_537, -32_767, -32_768, -32_769,
         2**63 - 1, -2**63 + 1, 3_000_000_000]


@pytest.mark.parametrize("limits", LIMITS)
def test_null_negative_and_boundary_keys(spark, rows, limits):
    facts = spark.createDataFrame([(i, k) for i, k in enumerate([*EDGES, None, 2, -2])], "n int, k bigint")
    for chosen in (EDGES[::2], EDGES[1::2]):
        master = spark.createDataFrame([(k,) for k in [*chosen, None]], "LocationID bigint")
        got = orphans(facts, master, labels={"k": "LOST"}, key_copies=False, **limits)
        lost = [(i,) for i, k in enumerate([*EDGES, None, 2, -2]) if k not in chosen]
        assert rows(got, "n") == sorted(lost, key=repr)


def test_bitmaps_need_no_shuffle_of_the_fact(spark, tmp_path, plan_text):
    spark.range(1000).selectExpr("id AS n", "id * 3 AS a", "id - 500 AS b").write.parquet(str(tmp_path / "f"))
    fact = spark.read.parquet(str(tmp_path / "f"))
    got = orphans(fact, spark.range(0, 2000, 2).toDF("LocationID"), labels={"a": "A", "b": "B"}, limit=0)
    plan = plan_text(got)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin LeftOuter") >= 2
    assert got.count() == sum(1 for i in range(1000) for k in (3 * i, i - 500)
                              if k % 2 or not 0 <= k < 2000)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_keys_beyond_32_bits(spark, rows, limit):
    facts = spark.createDataFrame([(1, 3_000_000_000), (2, 3_000_000_001), (3, None)],
                                  "n int, PULocationID bigint")
    for kind in ("bigint", "string", "double"):
        master = spark.createDataFrame([(3_000_000_000,)], "LocationID bigint").selectExpr(
            f"CAST(CAST(LocationID AS DECIMAL(20,0)) AS {kind}) AS LocationID")
        got = orphans(facts, master, labels={"PULocationID": "LOST"}, limit=limit)
        assert rows(got, "n", "PULocationID_int") == [(2, None), (3, None)]


def test_fact_is_read_once(spark, tmp_path, trips, master, plan_text):
    trips.write.parquet(str(tmp_path / "t"))
    fact = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_text(orphans(fact, master))
    assert plan.count(f"{tmp_path}/t]") == 1
    assert "Union" not in plan


def test_stamps_and_requirements(trips, master):
    found = stamp_orphans(orphans(trips, master), "job")
    assert found.columns[-2:] == ["job_name", "detected_at_utc"]
    with pytest.raises(ValueError, match="lacks"):
        orphans(trips.drop("DOLocationID"), master)
    with pytest.raises(ValueError, match="lacks"):
        orphans(trips, master.withColumnRenamed("LocationID", "location_id"))


def test_states(spark, rows):
    df = spark.createDataFrame([("ACTIVE",), ("ACTIVE",), ("UNKNOWN",), (None,)], "mdm_state string")
    got = lifecycle_snapshot(df, ["ACTIVE", "PROPOSED"], "job")
    assert rows(got, "mdm_state", "mdm_state_valid", "record_count") == sorted([
        ("ACTIVE", True, 2), ("UNKNOWN", False, 1), (None, False, 1)], key=repr)
    assert lifecycle_snapshot(df).columns == ["mdm_state", "record_count"]


def test_without_states_all_are_active(spark, rows):
    assert rows(lifecycle_snapshot(spark.range(3), ["ACTIVE"])) == [("ACTIVE", True, 3)]


def test_run_summary(spark):
    names = ["audit_history_out_path", "curated_trips_path", "job_name",
             "lifecycle_snapshot_path", "master_zones_path", "orphans_count", "orphans_out_path"]
    values = {n: n for n in names} | {"orphans_count": 384}
    df = run_summary(spark, values)
    assert df.columns == names + ["generated_at_utc"]
    assert df.first()["orphans_count"] == 384
