import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import catalog


@pytest.fixture
def database(spark):
    name = "lake_test"
    catalog.create_database(spark, name, "It's a lake", {"domain": "mobility", "owner": "o'x"})
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_database_properties(spark, database):
    catalog.create_database(spark, database, "ignored")
    catalog.update_database(spark, database, {"classification": "internal", "domain": "transport"})
    facts = {r["info_name"]: r["info_value"]
             for r in catalog.describe_database(spark, database).collect()}
    assert facts["Comment"] == "It's a lake"
    assert all(t in facts["Properties"] for t in ("data_owner,o'x", "internal", "transport"))


def test_crawl(spark, database, tmp_path):
    root = tmp_path / "curated"
    plain, parted = str(root / "plain"), str(root / "parted")
    spark.range(3).write.parquet(plain)
    spark.range(9).withColumn("k", F.col("id") % 3).write.partitionBy("k").parquet(parted)
    spark.range(2).write.option("header", True).csv(str(root / "listed"))
    spark.range(2).write.json(str(root / "lines"))
    (root / "empty").mkdir()
    (root / "_work").mkdir()
    (root / "changes" / "_delta_log").mkdir(parents=True)
    (root / "changes" / "_delta_log" / "0.json").write_text("{}")
    spark.range(1).write.mode("append").parquet(str(root / "changes"))
    late = root / "late"
    (late / "day=1").mkdir(parents=True)  # its first folder is empty
    spark.range(5).write.parquet(str(late / "day=2"))
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(root / "single.parquet")
    found = {d.table: d.source for d in catalog.discover(spark, str(root))}
    assert found == {"changes": "delta", "plain": "parquet", "parted": "parquet",
                     "listed": "csv", "lines": "json", "late": "parquet", "single": "parquet"}
    (root / "changes").rename(tmp_path / "changes")  # Delta may not be installed here

    def crawl():
        return {r.table: r.outcome for r in catalog.crawl(spark, database, str(root) + "/")}

    assert set(crawl().values()) == {"created"}
    assert spark.table(f"{database}.parted").count() == 9
    assert spark.table(f"{database}.late").count() == 5
    assert spark.table(f"{database}.single").count() == 6
    assert spark.table(f"{database}.listed").columns == ["id"]
    assert set(crawl().values()) == {"unchanged"}
    spark.range(4).withColumn("more", F.lit(1)).write.mode("overwrite").parquet(plain)
    (root / "lines").rename(tmp_path / "lines")
    assert crawl() == {"plain": "updated", "parted": "unchanged", "listed": "unchanged",
                       "lines": "missing", "late": "unchanged", "single": "unchanged"}
    assert spark.table(f"{database}.plain").columns == ["id", "more"]
    names = sorted(r["tableName"] for r in catalog.list_tables(spark, database).collect())
    assert names == ["late", "lines", "listed", "parted", "plain", "single"]
    details = {r["name"]: (r["location"], r["format"])
               for r in catalog.table_details(spark, database, names).collect()}
    assert details["plain"][0].endswith("/plain") and details["plain"][1] == "parquet"


def test_folders_with_points_and_marks_in_their_names(spark, database, tmp_path):
    root = tmp_path / "lake"
    for rows, name in enumerate(("orders.parquet", "by day", "a-b.v2", "twice.csv", "twice.parquet"), 1):
        spark.range(rows).coalesce(1).write.option("header", True).format(
            "csv" if name.endswith("csv") else "parquet").save(str(root / name))
    for outcome in ("created", "unchanged"):
        done = catalog.crawl(spark, database, str(root))
        assert {r.outcome for r in done} == {outcome}
        assert {r.table: r.path.rsplit("/", 1)[-1] for r in done} == {
            "orders": "orders.parquet", "by_day": "by day", "a_b_v2": "a-b.v2", "twice": "twice.csv",
            "twice_parquet": "twice.parquet"}
    rows = {r.table: spark.table(f"{database}.{r.table}").count() for r in done}
    assert rows == {"orders": 1, "by_day": 2, "a_b_v2": 3, "twice": 4, "twice_parquet": 5}


def test_a_table_follows_its_place(spark, database, tmp_path):
    for rows in (3, 8):
        path = str(tmp_path / f"at{rows}")
        spark.range(rows).write.parquet(path)
        outcome = catalog.register_tables(spark, database, [catalog.Dataset("moved", path)])[0].outcome
        assert outcome == ("created" if rows == 3 else "updated")
        assert spark.table(f"{database}.moved").count() == rows


def test_missing_path_is_reported(spark, database, tmp_path):
    gone = catalog.Dataset("gone", str(tmp_path / "gone"))
    assert catalog.register_tables(spark, database, [gone])[0].outcome == "missing"


def test_profile(spark, rows):
    df = spark.createDataFrame([(1, None), (2, None), (None, "x")], "a int, `b.c` string")
    assert rows(catalog.profile(df)) == [("a", "int", 3, 1), ("b.c", "string", 3, 2)]


def test_profile_reads_footers(spark, tmp_path, rows, plan_text):
    df = spark.createDataFrame(
        [(1, None, [1], "é"), (2, None, None, None), (None, "x", [], "")],
        "a int, `b.c` string, d array<int>, e string")
    df.repartition(2).write.parquet(str(tmp_path / "t"))
    found = catalog.profile_files(spark, str(tmp_path / "t"))
    assert rows(found) == rows(catalog.profile(df))
    plan = plan_text(found)
    assert "COUNT(e)" in plan and "ReadSchema: struct<d:array<int>>" in plan
    assert not any("e:string" in line for line in plan.splitlines() if "ReadSchema" in line)


def test_preview(spark, plan_text):
    df = spark.range(100)
    top = catalog.preview(df, 3, F.desc("id"))
    assert [r["id"] for r in top.collect()] == [99, 98, 97]
    assert "TakeOrderedAndProject" in plan_text(top)
    assert catalog.preview(df, 5).count() == 5


def test_drifting_files_and_conflicts(spark, tmp_path):
    root = str(tmp_path / "drift")
    spark.range(3).write.parquet(f"{root}/grown/a")
    spark.range(3).selectExpr("id", "'x' AS extra").write.parquet(f"{root}/grown/b")
    spark.range(3).selectExpr("id", "2.5D AS third").write.parquet(f"{root}/grown/c")
    for i, folder in enumerate(("a", "b", "c")):  # one folder with three files
        spark.read.parquet(f"{root}/grown/{folder}").coalesce(1).write.mode("append").parquet(f"{root}/whole")
    spark.range(2).write.parquet(f"{root}/apart")
    spark.range(2).selectExpr("CAST(id AS STRING) AS id").write.mode("append").parquet(f"{root}/apart")
    spark.range(4).selectExpr("id", "id % 2 AS day").write.partitionBy("day").parquet(f"{root}/parted")
    catalog.create_database(spark, "drifting", location=str(tmp_path / "d.db"))
    outcomes = {r.table: r.outcome for r in catalog.crawl(spark, "drifting", root)}
    assert outcomes["apart"] == "conflict" and outcomes["grown"] == "unreadable" and outcomes["whole"] == outcomes["parted"] == "created"
    assert set(spark.table("drifting.whole").columns) == {"id", "extra", "third"}
    assert spark.table("drifting.whole").count() == 9
    assert spark.table("drifting.whole").where("extra = 'x'").count() == 3
    assert sorted(map(tuple, spark.table("drifting.parted").collect())) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    again = {r.table: r.outcome for r in catalog.crawl(spark, "drifting", root)}
    assert again["whole"] == again["parted"] == "unchanged"


def test_a_second_crawl_opens_changed_datasets_only(spark, tmp_path, monkeypatch):
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    for name in ("one", "two", "three"):
        spark.range(5).write.parquet(f"{root}/{name}")
    catalog.create_database(spark, "increments", location=str(tmp_path / "i.db"))
    opened = []
    plain = catalog._register
    monkeypatch.setattr(catalog, "_register", lambda s, d, x: opened.append(x.table) or plain(s, d, x))

    def crawl():
        opened.clear()
        found = catalog.crawl(spark, "increments", root, state)
        return {r.table: r.outcome for r in found}, sorted(opened)

    assert crawl() == ({n: "created" for n in ("one", "two", "three")}, ["one", "three", "two"])
    assert crawl() == ({n: "unchanged" for n in ("one", "two", "three")}, [])
    spark.range(2).selectExpr("id", "1 AS more").write.mode("append").parquet(f"{root}/two")
    spark.range(2).write.parquet(f"{root}/four")
    assert crawl() == ({"one": "unchanged", "two": "updated", "three": "unchanged", "four": "created"},
                       ["four", "two"])
    assert crawl()[1] == []
    spark.sql("DROP TABLE increments.one")
    assert crawl() == ({"one": "created", **{n: "unchanged" for n in ("two", "three", "four")}}, ["one"])


def test_types_that_grew_are_widened(spark, tmp_path):
    root = str(tmp_path / "grew")

    def add(name, *columns):
        spark.range(3).selectExpr(*columns).coalesce(1).write.mode("append").parquet(f"{root}/{name}")

    for _ in range(3):  # three files of each kind, so that there are parts to merge
        add("numbers", "CAST(id AS INT) AS n", "CAST(id AS FLOAT) AS x", "CAST(id AS DECIMAL(5,2)) AS d")
    for _ in range(3):
        add("numbers", "id + 3000000000 AS n", "id + 0.1D AS x", "CAST(id AS DECIMAL(9,4)) AS d", "'y' AS late")
    add("numbers", "CAST(id AS SMALLINT) AS n")
    add("texts", "id AS n")
    add("texts", "CAST(id AS STRING) AS n")
    for day in (1, 2):
        kind = "INT" if day == 1 else "BIGINT"
        spark.range(2).selectExpr(f"CAST(id AS {kind}) AS n", f"{day} AS day").write.mode(
            "append").partitionBy("day").parquet(f"{root}/parted")
    catalog.create_database(spark, "widened", location=str(tmp_path / "w.db"))
    outcomes = {r.table: r.outcome for r in catalog.crawl(spark, "widened", root)}
    assert outcomes == {"numbers": "created", "texts": "conflict", "parted": "created"}
    found = spark.table("widened.numbers")
    assert dict(found.dtypes) == {"n": "bigint", "x": "double", "d": "decimal(9,4)", "late": "string"}
    sums = found.selectExpr("count(*)", "sum(n)", "round(sum(x), 6)", "sum(d)", "count(late)").first()
    assert [float(v) for v in sums] == [21, 3 * 3 + 3 * 9_000_000_003 + 3, 3 * 3 + 3 * 3.3, 18, 9]
    assert sorted(map(tuple, spark.table("widened.parted").collect())) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert {r.outcome for r in catalog.crawl(spark, "widened", root)} == {"unchanged", "conflict"}


def test_wider_types(spark):
    def wider(a, b):
        found = catalog.wider_type(*(T.StructType.fromDDL(f"c {t}")["c"].dataType for t in (a, b)))
        return found.simpleString() if found else None

    cases = {("int", "float"): "double", ("tinyint", "smallint"): "smallint", ("bigint", "double"): None,
             ("bigint", "int"): "bigint", ("date", "int"): None, ("string", "string"): "string",
             ("decimal(38,0)", "decimal(5,2)"): None, ("decimal(4,1)", "decimal(5,3)"): "decimal(6,3)",
             ("struct<a:int>", "struct<a:bigint,b:string>"): "struct<a:bigint,b:string>",
             ("struct<a:int>", "struct<a:string>"): None, ("array<int>", "array<bigint>"): None}
    assert {pair: wider(*pair) for pair in cases} == cases
