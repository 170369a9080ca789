import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewarden.operators.keyed import (
    Skew,
    heavy_keys,
    lookup_join,
    measure,
    require_unique,
    salted_join,
    with_group_size,
)

SKEW = Skew(rows=50)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 7, some have no key, the rest are spread."""
    return spark.range(600).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None)
        .otherwise(F.col("id") % 90).cast("int").alias("k"))


@pytest.fixture(scope="module")
def side(spark):
    return spark.range(60).select(F.col("id").cast("int").alias("sk"),
                                  F.concat(F.lit("v"), "id").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salting_changes_nothing(skewed, side, rows, how):
    plain = skewed.join(side, F.col("k") == F.col("sk"), how)
    salted = salted_join(skewed, side, ["k"], ["sk"], how, skew=SKEW)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)
    assert rows(lookup_join(skewed, side, "k", "sk", how, limit=0, skew=SKEW)) == rows(plain)
    assert rows(lookup_join(skewed, side, "k", "sk", how)) == rows(plain)


def test_null_safe_salting(skewed, side, rows):
    with_null = side.union(side.sparkSession.sql("SELECT CAST(NULL AS INT), 'none'"))
    plain = skewed.join(with_null, F.col("k").eqNullSafe(F.col("sk")), "inner")
    salted = salted_join(skewed, with_null, ["k"], ["sk"], "inner", null_safe=True, skew=SKEW)
    assert rows(salted) == rows(plain)


def test_heavy_key_is_spread(spark, skewed, side):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(skewed, side, ["k"], ["sk"], "left", skew=Skew(rows=10))
        spread = joined.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        lone = skewed.join(side, F.col("k") == F.col("sk"), "left").filter("k = 7")
        assert spread == 4
        assert lone.select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_group_size_equals_window_count(skewed, rows):
    expected = skewed.withColumn("size", F.count("*").over(Window.partitionBy("k")))
    got = with_group_size(skewed, ["k"], "size", skew=SKEW)
    assert rows(got, "n", "k", "size") == rows(expected, "n", "k", "size")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_measure(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "c"), (2, None), (None, "d"), (None, "e"),
                                (None, "f")], "k int, t string")
    size = measure(df, "k")
    assert (size.rows, size.largest_key) == (6, 2)
    assert size.bytes == 6 * 32 + 6
    assert size.fits() and not size.fits(100)
    with pytest.raises(ValueError, match="not unique"):
        require_unique(size, "k")
    assert measure(df.filter("k > 9"), "k").rows == 0


def test_keys_of_unlike_types(spark, skewed, side, rows):
    wide = side.withColumn("sk", F.col("sk").cast("bigint"))
    plain = skewed.join(side, F.col("k") == F.col("sk"), "left")
    assert rows(salted_join(skewed, wide, ["k"], ["sk"], "left", skew=SKEW), "n", "v") == rows(
        plain, "n", "v")
    with pytest.raises(ValueError, match="differ in type"):
        salted_join(skewed, side.withColumn("sk", F.col("sk").cast("string")), ["k"], ["sk"], "left")


@pytest.mark.parametrize("left, right", [
    ("double", "bigint"), ("int", "string"), ("string", "bigint"), ("decimal(20,0)", "bigint"),
    ("smallint", "int"), ("string", "date")])
def test_lookup_is_the_same_at_any_size(spark, rows, left, right):
    """Keys of unlike types are compared alike, be the look-up side broadcast or shuffled."""
    keys = ["1", "2", "2", "7", None] if right != "date" else ["2024-01-05", "x", None]
    facts = spark.createDataFrame(list(enumerate(keys)), "n int, t string").select(
        "n", F.col("t").try_cast(left).alias("k"))
    known = spark.createDataFrame([("1",), ("2",), ("2024-01-05",)], "t string").select(
        F.col("t").try_cast(right).alias("sk"), "t").dropna()
    for how in ("left", "left_anti"):
        small, large = (lookup_join(facts, known, "k", "sk", how, limit=limit, skew=Skew(rows=2))
                        for limit in (10**9, 0))
        assert small.columns == large.columns and rows(small) == rows(large)
        if how == "left":
            assert small.where("t IS NOT NULL").count() == (3 if right != "date" else 1)


def test_salts_follow_the_number_of_rows(skewed):
    counts = skewed.groupBy("k").agg(F.count("*").alias("n"))
    got = [r["__salts"] for r in heavy_keys(counts, "n", Skew(rows=30)).collect()]
    assert max(got) == 200 // 30 + 1 and len(got) <= 3
