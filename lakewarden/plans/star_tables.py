"""The test tables in the roles of trips, zones and master data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as trips: ordered = start, shipped = end, nations = places.

    No hints: Spark broadcasts a side only if its size statistics allow it, and splits skewed
    shuffle partitions at run time.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customers, suppliers = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey", "l_linenumber",
            F.col("l_suppkey").cast("int").alias("VendorID"),
            F.col("o_orderdate").alias("pickup_datetime"),
            F.col("l_shipdate").alias("dropoff_datetime"),
            F.col("c_nationkey").alias("PULocationID"),
            F.col("s_nationkey").alias("DOLocationID"),
            F.col("l_linenumber").alias("passenger_count"),
            F.col("l_linenumber").alias("RatecodeID"),
            F.col("l_quantity").alias("trip_distance"),
            F.col("c_acctbal").alias("fare_amount"),
            F.col("o_totalprice").alias("total_amount"),
            F.col("l_extendedprice").alias("tip_amount"),
            F.col("l_tax").alias("tolls_amount"),
            F.col("l_discount").alias("extra"),
        )
    )


TRIPS_SQL = """
trips AS (
  SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS INTEGER) AS VendorID,
         o_orderdate AS pickup_datetime, l_shipdate AS dropoff_datetime,
         c_nationkey AS PULocationID, s_nationkey AS DOLocationID,
         l_linenumber AS passenger_count, l_linenumber AS RatecodeID,
         l_quantity AS trip_distance, c_acctbal AS fare_amount, o_totalprice AS total_amount,
         l_extendedprice AS tip_amount, l_tax AS tolls_amount, l_discount AS extra
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as zones, regions as boroughs."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("LocationID"), F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.concat(F.lit("SERVICE "), F.col("r_regionkey").cast("string")).alias("service_zone"),
    )


ZONES_SQL = """
zones AS (
  SELECT n_nationkey AS LocationID, r_name AS Borough, n_name AS Zone,
         'SERVICE ' || CAST(r_regionkey AS VARCHAR) AS service_zone
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
