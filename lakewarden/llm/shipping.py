"""Readies a session: sends this package to the executors, whose Python workers import the operators
from it, and bounds the batches in which rows go to them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakewarden.session import ship_package

# Rows in an Arrow batch. Rows here carry texts of some kilobytes, so the usual 10,000 would take
# tens of megabytes on both sides of every running task.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a zip file, served to executors by Spark itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)
