"""Records of CSV files that are cut into splits, against the reader that takes a file whole."""

import random

import pytest
from pyspark.sql import types as T

from lakewarden.sources.csv_records import csv_records, read_csv_records
from lakewarden.sources.readers import read_csv
from lakewarden.sources.store import write_csv

SCHEMA = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("t", T.StringType()),
                       T.StructField("d", T.DoubleType())])


@pytest.fixture
def small_splits(spark):
    """Splits of about 100 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "100")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def _odd_rows(count):
    chosen = random.Random(8)
    marks = ["\n", "\n\n", '"', '""', ",", "\r\n", "\r", " ", "ab", "é", '\n"', '",\n', "x" * 90]
    texts = [None, "", "\n", '"', '"\n"', "\r", "a\r", "long\n" * 200]
    texts += ["".join(chosen.choice(marks) for _ in range(chosen.randrange(0, 9)))
              for _ in range(count - len(texts))]
    return [(i, t, i / 4 if i % 5 else None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("files", [1, 3])
def test_equals_the_whole_file_reader(spark, tmp_path, rows, small_splits, files):
    df = spark.createDataFrame(_odd_rows(300), SCHEMA)
    path = str(tmp_path / "t")
    write_csv(df.repartition(files), path)
    found = read_csv_records(spark, path, SCHEMA)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 3 * files
    assert rows(found) == rows(df) == rows(read_csv(spark, path, SCHEMA, multi_line=True))


def test_records_are_numbered_through_in_their_order(spark, tmp_path, small_splits):
    given = _odd_rows(200)
    lines = [f'{n},"{(t or "").replace(chr(34), chr(34) * 2)}",' for n, t, _ in given]
    (tmp_path / "a.csv").write_text("\n".join(["n,t,d", *lines]), newline="")  # no line feed at the end
    found = csv_records(spark, str(tmp_path)).orderBy("number").collect()
    assert [r["number"] for r in found] == list(range(1, 202))
    assert [r["record"] for r in found[1:]] == lines


def test_odd_files(spark, tmp_path, rows, small_splits):
    (tmp_path / "a.csv").write_text('d,t,n\r\n0.5,"x\r\ny",1\r\n\r\nmany,z\r\n\n,,3\r\n', newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("d,t,n")
    assert rows(read_csv_records(spark, str(tmp_path), SCHEMA)) == [
        (1, "x\r\ny", 0.5), (3, None, None), (None, "z", None)]
    with pytest.raises(ValueError, match="lacks the columns"):
        read_csv_records(spark, str(tmp_path), T.StructType.fromDDL("q int"))
    (tmp_path / "b.csv").write_text('d,t,n\n1,"open,2\n' * 3)
    with pytest.raises(ValueError, match="inside quotes.*b.csv"):
        read_csv_records(spark, str(tmp_path), SCHEMA)


@pytest.mark.parametrize("batch", ["3", "10000"])
@pytest.mark.parametrize("split_bytes", ["300", "100000"])
def test_lines_stay_in_the_task_that_reads_them(spark, tmp_path, rows, plan_text, batch, split_bytes):
    df = spark.createDataFrame(_odd_rows(150), SCHEMA)
    path = str(tmp_path / "t")
    write_csv(df.repartition(5), path)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch,
                "spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in settings}
    try:
        for n, value in settings.items():
            spark.conf.set(n, value)
        found = read_csv_records(spark, path, SCHEMA)
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    plan = plan_text(found)
    assert "Window" not in plan and "Scan text" not in plan  # records were put together while lines were read
    assert rows(found) == rows(df)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
