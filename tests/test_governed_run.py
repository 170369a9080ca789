import datetime as dt
import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from lakewarden.fixed_values import END_ORPHAN, START_ORPHAN
from lakewarden.operators.audit import orphans
from lakewarden.operators.quality import AutoRules, QualityBelowThreshold
from lakewarden.plans.governed_run import Artifacts, GovernedRun, Places

T0 = dt.datetime(2024, 1, 1, 10)
ZONES = """LocationID,Borough,Zone,service_zone
1,Bay,Alpha,Yellow
2,Bay,Beta,Green
3,Hill,Beta,Green
4,Hill,Gamma,Yellow
"""
METADATA = {"dataset_name": "trips", "classification": "internal", "source": "TEST",
            "schema": [{"name": "fare_amount", "type": "double"}]}
QUALITY = {"version": "1", "policy": {"default_min_pass_rate": 0.5}, "rules": [
    {"id": "fare_under_100", "expression_sql": "fare_amount < 100"},
    {"id": "start_known", "expression_sql": "pu_zone IS NOT NULL"}]}
MATCH = {"version": "1", "blocking_keys": [{"expression": "upper(Zone)"}]}
LIFECYCLE = {"version": "1", "states": [
    {"name": "ACTIVE"}, {"name": "PROPOSED"}, {"name": "REJECTED"}]}


@pytest.fixture
def setup(spark, tmp_path):
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    data = [
        (1, T0, T0 + hour, 1, 4, "10.0"), (2, T0 + day, T0 + day + hour, 4, 1, "20.0"),
        (3, T0, T0 + hour, 2, 1, "30.0"),       # start merges away: orphan
        (4, T0, T0 + hour, 2, 3, "40.0"),       # both ends: two orphans
        (5, T0, T0 + hour, 9, 1, "50.0"),       # unknown start: rejected
        (6, T0, T0 + hour, 1, 1, "500.0"),      # dear: rejected
        (7, T0, T0 - hour, 1, 1, "1.0"),        # ends before it starts: dropped
        (8, T0, T0 + hour, 1, 1, "odd"),        # no fare: dropped
    ]
    spark.createDataFrame(data, "VendorID int, tpep_pickup_datetime timestamp,"
                          " tpep_dropoff_datetime timestamp, PULocationID int, DOLocationID int,"
                          " fare_amount string").write.parquet(str(tmp_path / "trips"))
    (tmp_path / "zones.csv").write_text(ZONES)
    documents = {"metadata": METADATA, "quality": QUALITY, "match": MATCH, "lifecycle": LIFECYCLE}
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    places = Places.under(str(tmp_path / "out"), str(tmp_path / "trips") + "/",
                          str(tmp_path / "zones.csv"))
    return places, {n: str(tmp_path / f"{n}.json") for n in documents}


def job(spark, setup, **options):
    places, paths = setup
    numbers = {k: options.pop(k) for k in ("min_pass_rate",) if k in options}
    return GovernedRun(spark, places, Artifacts.load(spark, paths, **numbers), "job",
                       table_format="parquet", **options)


def test_whole_run_twice(spark, setup, rows):
    places = setup[0]
    outcomes = []
    for _ in range(2):
        job(spark, setup).run("all")
        outcomes.append({
            "curated": rows(spark.read.parquet(places.curated), "VendorID", "pu_zone", "do_zone",
                            "trip_duration_min", "governance_zone"),
            "passed": rows(spark.read.parquet(places.passed), "VendorID"),
            "rejects": [(r["VendorID"], r["failed_rules"])
                        for r in spark.read.parquet(places.rejects).orderBy("VendorID").collect()],
            "master": rows(spark.read.parquet(places.master), "LocationID"),
            "queue": rows(spark.read.parquet(places.steward_queue), "LocationID", "mdm_state"),
            "orphans": rows(spark.read.parquet(places.orphans), "VendorID", "orphan_type"),
            "lifecycle": rows(spark.read.parquet(places.lifecycle), "mdm_state",
                              "mdm_state_valid", "record_count"),
        })
    assert outcomes[0] == outcomes[1]
    got = outcomes[0]
    assert got["curated"][0] == (1, "Alpha", "Gamma", 60.0, "curated")
    assert [v for v, *_ in got["curated"]] == [1, 2, 3, 4, 5, 6]
    assert got["passed"] == [(1,), (2,), (3,), (4,)]
    assert got["rejects"] == [(5, ["start_known"]), (6, ["fare_under_100"])]
    assert got["master"] == [(1,), (4,)]
    assert got["queue"] == [(2, "PROPOSED"), (3, "PROPOSED")]
    assert got["orphans"] == [(3, "PICKUP_NOT_IN_MASTER"), (4, "DROPOFF_NOT_IN_MASTER"),
                              (4, "PICKUP_NOT_IN_MASTER")]
    assert got["lifecycle"] == [("ACTIVE", True, 2)]
    report = spark.read.json(places.quality_report).first()
    counts = ("total_rows", "passed_rows", "fare_under_100_fail_count")
    assert tuple(report[c] for c in counts) == (6, 4, 1)
    assert spark.read.parquet(places.summary).first()["orphans_count"] == 3
    history = spark.read.parquet(places.history)
    assert rows(history, "table_name", "num_rows") == [
        ("curated_trips", 4), ("curated_trips", 4), ("master_zones", 2), ("master_zones", 2)]
    assert history.select("run_id").distinct().count() == 2
    folders = spark.read.parquet(places.validated).inputFiles()
    assert {f.split("pickup_date=")[1][:10] for f in folders} == {"2024-01-01", "2024-01-02"}


def test_gate_raises_after_outputs_are_written(spark, setup):
    run = job(spark, setup, min_pass_rate=0.9)
    run.run("day6")
    run.run("enrich")
    with pytest.raises(QualityBelowThreshold):
        run.run("quality")
    assert spark.read.parquet(run.places.passed).count() == 4
    assert spark.read.json(run.places.quality_report).count() == 1


def test_rules_from_the_columns(spark, setup):
    run = job(spark, setup, auto_rules=AutoRules())
    for stage in ("conform", "enrich", "quality"):
        run.run(stage)
    rejects = spark.read.parquet(run.places.rejects)
    assert "vendor_not_null" in rejects.columns and "failed_rules" not in rejects.columns
    assert spark.read.parquet(run.places.passed).count() == 6


def test_unknown_mode_and_empty_paths(spark, setup):
    with pytest.raises(ValueError, match="unknown mode"):
        job(spark, setup).run("day11")
    with pytest.raises(ValueError, match="raw_zones"):
        Places.under("/x", "/trips", " ")


def test_number_of_jobs(spark, setup):
    """Schemas of own writes are known and reports are computed once: few jobs a stage."""
    run = job(spark, setup)
    counted = {}
    for stage, most in (("conform", 5), ("enrich", 8), ("quality", 8), ("match", 14), ("audit", 17)):
        spark.sparkContext.setJobGroup(stage, stage)
        try:
            run.run(stage)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counted[stage] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(stage))
        assert counted[stage] <= most, counted


def test_many_small_tasks_write_without_a_sort(spark, setup, monkeypatch):
    from lakewarden.plans.governed_run import run_settings
    names, seen = list(run_settings(spark)), []
    before = [spark.conf.get(n, None) for n in names]
    run = job(spark, setup)
    write = run.store.write
    monkeypatch.setattr(run.store, "write", lambda df, *args, **kw: seen.append(
        {n: spark.conf.get(n, None) for n in names}) or write(df, *args, **kw))
    run.run()
    assert seen and all(s == run_settings(spark) for s in seen)
    assert [spark.conf.get(n, None) for n in names] == before
    files = list(Path(run.places.passed).rglob("*.parquet"))
    kinds = {pq.ParquetFile(f).schema.column(i).physical_type for f in files
             for i, name in enumerate(pq.ParquetFile(f).schema.names) if name.startswith("tpep_")}
    assert kinds == {"INT64"}


def test_rows_are_repeated_for_orphans_in_compiled_code(spark, rows, plan_text):
    fact = spark.createDataFrame([(1, 2), (1, 9), (8, 9), (None, 1)], "PULocationID int, DOLocationID int")
    found = orphans(fact, spark.createDataFrame([(1,), (2,)], "LocationID int"), key_copies=False)
    assert rows(found) == sorted([(1, 9, END_ORPHAN), (8, 9, START_ORPHAN), (8, 9, END_ORPHAN),
                                  (None, 1, START_ORPHAN)], key=repr)
    plan = plan_text(found)
    assert "explode(array(" in plan and "filter(array(" not in plan
