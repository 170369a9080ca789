import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.session import fresh_path, prepare_session, shared_folder
from lakewarden.sources.readers import (
    WRONG_FIELDS,
    ZONE_SCHEMA,
    read_csv,
    read_csv_checked,
    read_csv_inferred,
    read_json_lines,
    read_optional,
    read_parquet,
    read_small_text,
)
from lakewarden.sources.store import (
    TableStore,
    delta_installed,
    staged,
    write_csv,
    write_parquet,
    write_report,
)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "commits"), format="parquet")


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert prepare_session(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def session_without_folder(master):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default),
                           sparkContext=context)


def test_only_a_local_session_gets_a_folder_of_its_own():
    local = session_without_folder("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session_without_folder("spark://head:7077"))


def test_zone_csv(spark, tmp_path, rows):
    (tmp_path / "z.csv").write_text(
        "Zone,LocationID,Borough,service_zone\nA,1,B,S\nC,x,,S\n")
    df = read_csv(spark, str(tmp_path / "z.csv"), ZONE_SCHEMA)
    assert rows(df) == [(1, "B", "A", "S"), (None, None, "C", "S")]
    with pytest.raises(ValueError, match="lacks"):
        read_csv(spark, str(tmp_path / "z.csv"), T.StructType([T.StructField("q", T.StringType())]))
    assert dict(read_csv_inferred(spark, str(tmp_path / "z.csv")).dtypes)["LocationID"] == "string"


def test_optional_input(spark, tmp_path):
    df, reason = read_optional(lambda: read_parquet(spark, str(tmp_path / "nothing")))
    assert df is None and "PATH_NOT_FOUND" in reason
    df, reason = read_optional(lambda: spark.range(2))
    assert df.count() == 2 and reason is None
    df, reason = read_optional(lambda: spark.read.format("no-such-format").load("x"))
    assert df is None and reason


def test_several_part_folders(spark, tmp_path):
    for i in range(2):
        write_parquet(spark.range(i * 10, i * 10 + 5), str(tmp_path / f"p{i}"))
    (tmp_path / "p0" / "_delta_log").mkdir()
    (tmp_path / "p0" / "_delta_log" / "0.json").write_text("{}")
    assert read_parquet(spark, str(tmp_path / "p0"), str(tmp_path / "p1")).count() == 10


def test_report_and_export(spark, tmp_path, rows):
    write_report(spark.sql("SELECT 1 AS a, 'x' AS b"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*.json"))) == 1
    assert rows(read_json_lines(spark, str(tmp_path / "r"), T.StructType.fromDDL("a int, b string"))) \
        == [(1, "x")]
    assert read_json_lines(spark, str(tmp_path / "r")).first()["a"] == 1
    write_csv(spark.range(3), str(tmp_path / "c"), one_file=True)
    assert len(list((tmp_path / "c").glob("part-*.csv"))) == 1


def test_texts_survive_csv(spark, tmp_path, rows):
    texts = ["  lead ", "", None, 'say "so"', "two\nlines", "a,b", '"', "\\", "#x", "\t", "''", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    write_csv(df, str(tmp_path / "t"))
    assert rows(read_csv(spark, str(tmp_path / "t"), df.schema, multi_line=True)) == rows(df)


def test_small_text_of_several_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second\nthird")
    (tmp_path / "a.txt").write_text("first")
    assert read_small_text(spark, str(tmp_path)) == "first\nsecond\nthird"
    assert read_small_text(spark, str(tmp_path / "a.txt")) == "first"


def test_noted_writes(store, tmp_path, rows, spark):
    path = str(tmp_path / "t")
    assert store.write(spark.range(5), path).rows == 5
    assert store.write(spark.range(3).withColumn("k", F.lit(1)), path, partition_by="k").rows == 3
    assert store.read(path).count() == 3
    store.write(spark.range(2), str(tmp_path / "u"))
    audit = store.history_audit({"t": path, "u": str(tmp_path / "u")}, "job")
    assert rows(audit, "table_name", "num_rows", "partition_by") == [
        ("t", 3, "k"), ("t", 5, None), ("u", 2, None)]
    assert {"table_path", "job_name", "captured_at_utc", "run_id"} <= set(audit.columns)
    assert {r["run_id"] for r in audit.collect()} == {store.run_id}
    assert store.history(str(tmp_path / "never")).count() == 0
    again = TableStore(spark, store.audit_path, format="parquet")
    again.write(spark.range(1), path)
    assert again.history(path).count() == 3 and again.read(path).columns == ["id"]


def test_partition_values_keep_their_type(store, tmp_path, rows, spark):
    df = spark.createDataFrame([("007", 1), ("08", 2), ("007", 3)], "code string, n int")
    store.write(df, str(tmp_path / "t"), partition_by="code")
    assert rows(store.read(str(tmp_path / "t")), "code", "n") == [("007", 1), ("007", 3), ("08", 2)]
    assert sorted(p.name for p in (tmp_path / "t").glob("code=*")) == ["code=007", "code=08"]


def test_rows_of_empty_and_shuffled_writes(store, tmp_path, spark):
    assert store.write(spark.range(0), str(tmp_path / "e")).rows == 0
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert store.write(grouped, str(tmp_path / "g")).rows == 7
    empty = grouped.filter("k > 99")
    assert store.write(empty, str(tmp_path / "h"), partition_by="k").rows == 0


def test_pruned_partitions(store, tmp_path, spark, plan_text):
    store.write(spark.range(100).withColumn("k", F.col("id") % 4), str(tmp_path / "t"),
                partition_by="k")
    plan = plan_text(store.read(str(tmp_path / "t")).filter("k = 2"))
    assert "PartitionFilters: [isnotnull(k" in plan


def test_format_is_settled_once(spark, tmp_path):
    expected = "delta" if delta_installed(spark) else "parquet"
    assert TableStore(spark, str(tmp_path / "c")).format == expected


def test_staged_table_is_cut_off_from_its_source(spark, rows):
    df = staged(spark.range(5).withColumn("t", F.lit("x")), "five")
    assert rows(df)[0] == (0, "x")
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


NUMBERS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType()),
                        T.StructField("day", T.DateType())])


def test_malformed_lines_are_kept_apart(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text(
        'name,extra,n,day\nA,x,1,2024-01-02\n"B, b",x,two,2024-13-02\nC,,,\nD,x\n,x,7,\nE,x,8,2024-01-01,9\n')
    good, bad = read_csv_checked(spark, str(tmp_path / "a.csv"), NUMBERS)
    found = [(r["n"], r["name"], str(r["day"])) for r in good.collect()]
    assert found == [(1, "A", "2024-01-02"), (None, "C", "None"), (7, None, "None")]
    held = {r["line"]: [(p["column"], p["reason"]) for p in r["problems"]] for r in bad.collect()}
    assert held == {
        '"B, b",x,two,2024-13-02': [("n", "not a value of type int"),
                                    ("day", "not a value of type date")],
        "D,x": [(None, WRONG_FIELDS)], "E,x,8,2024-01-01,9": [(None, WRONG_FIELDS)]}
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv"}
    assert good.count() == 3 and bad.count() == 3
    with pytest.raises(ValueError, match="lacks"):
        read_csv_checked(spark, str(tmp_path / "a.csv"), ZONE_SCHEMA)


def test_malformed_records_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,name,day\n1,"a\nb",2024-01-02\nx,"c\nd",\n')
    good, bad = read_csv_checked(spark, str(tmp_path / "a.csv"), NUMBERS, multi_line=True)
    assert [r["name"] for r in good.collect()] == ["a\nb"]
    assert [p["column"] for p in bad.first()["problems"]] == ["n"]
    assert bad.count() == 1


def test_only_given_partitions_are_replaced(spark, store, tmp_path, rows):
    path = str(tmp_path / "t")
    days = spark.range(20).select("id", F.concat(F.lit("d"), (F.col("id") % 10).cast("string")).alias("day"),
                                  F.lit("old").alias("state"))
    store.write(days, path, partition_by="day", only_given=True)  # the first write is of all
    again = days.where("day IN ('d3', 'd5') AND id < 10").withColumn("state", F.lit("new"))
    nameless = spark.createDataFrame([("new", 99, None)], "state string, id long, day string")
    written = store.write(again.unionByName(nameless), path, partition_by="day", only_given=True)
    assert written.rows == 3
    expected = [(i, f"d{i % 10}", "old") for i in range(20) if i % 10 not in (3, 5)] + [
        (3, "d3", "new"), (5, "d5", "new"), (99, None, "new")]
    assert rows(store.read(path), "id", "day", "state") == sorted(expected, key=repr)
    notes = store.writes().orderBy("written_at").collect()
    assert json.loads(notes[1]["partitions_replaced"]) == ["d3", "d5", None]
    assert len(json.loads(notes[0]["partitions_replaced"])) == 10
    store.write(days.where("false"), path, partition_by="day", only_given=True)
    assert store.read(path).count() == 19
    store.write(days, path, partition_by="day")
    assert store.read(path).count() == 20


def test_partitions_of_another_table_are_refused(spark, store, tmp_path):
    path = str(tmp_path / "t")
    days = spark.range(4).selectExpr("id", "id % 2 AS day")
    store.write(days, path, partition_by="day")
    with pytest.raises(ValueError, match="columns"):
        store.write(days.withColumn("more", F.lit(1)), path, partition_by="day", only_given=True)
    with pytest.raises(ValueError, match="partitioned by day"):
        store.write(days, path, partition_by="id", only_given=True)
    with pytest.raises(ValueError, match="takes a partition column"):
        store.write(days, path, only_given=True)
