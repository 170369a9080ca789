"""Tables by path, and an audit of the writes to them.

With Delta installed, tables are Delta tables and their history is the table's own. Without it they
are Parquet folders, and each write adds a row to an audit table: when, by which run, where to, in
what format and schema, and how many rows. It is a list of writes, not a table history.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.columns import moment_column, run_time, stamp
from lakewarden.session import fresh_path
from lakewarden.sources.readers import CSV_OPTIONS

DELTA, PARQUET = "delta", "parquet"

AUDIT_SCHEMA = T.StructType([
    T.StructField("written_at", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("written_path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("partition_by", T.StringType()),
    T.StructField("num_rows", T.LongType()),
    T.StructField("table_schema", T.StringType()),
    T.StructField("partitions_replaced", T.StringType()),
])


@dataclass(frozen=True)
class Written:
    path: str
    format: str
    rows: int


def delta_installed(spark: SparkSession) -> bool:
    """Whether Spark finds the Delta source. Asked once per session, before any data is written."""
    try:
        spark.read.format(DELTA).load("/")
    except (AnalysisException, Py4JJavaError) as problem:
        return "DATA_SOURCE_NOT_FOUND" not in str(problem)
    return True


class TableStore:
    def __init__(self, spark: SparkSession, audit_path: str, *, format: str | None = None):
        self.spark = spark
        self.audit_path = audit_path
        self.format = format or (DELTA if delta_installed(spark) else PARQUET)
        self.run_id = uuid.uuid4().hex
        self._schemas: dict[str, T.StructType] = {}  # of what this store wrote itself
        if self.format == PARQUET:
            # The audit table exists from here on, be it empty.
            spark.createDataFrame([], AUDIT_SCHEMA).write.mode("append").parquet(audit_path)

    def read(self, path: str) -> DataFrame:
        """The table as last written.

        Folder names hold partition values as text, so a Parquet table is read with the schema
        of its last write: a text value that looks like a number stays text.
        """
        reader = self.spark.read.format(self.format)
        if path in self._schemas:
            reader = reader.schema(self._schemas[path])
        elif self.format == PARQUET:
            last = (self.writes().filter(F.col("written_path") == path)
                    .agg(F.max_by("table_schema", "written_at").alias("schema")).first())
            if last["schema"] is not None:
                reader = reader.schema(T.StructType.fromJson(json.loads(last["schema"])))
        return reader.load(path)

    def write(self, df: DataFrame, path: str, *, partition_by: str | None = None,
              clustered: bool = False, only_given: bool = False) -> Written:
        """Replace the table, or with `only_given` just the partitions that `df` has rows of.

        With `only_given` all other partitions stay as they are. Columns and partition column have to
        be those of the last noted write; the note names the partitions as a JSON list. A table that
        was not written before is written whole. A Delta table takes the same option.

        A partitioned write is rebalanced first: each partition value is gathered into few files
        instead of one per task, and a value with very many rows is still split over tasks.
        That takes a shuffle; rows that come `clustered`, because they were read from a table
        partitioned alike and stayed in their tasks, do without.

        Rows are counted as the tasks write them. The count sits in the last stage, where Spark
        takes the numbers of each partition once, whatever is run again.
        """
        replaced = None
        if only_given:
            if not partition_by:
                raise ValueError("replacing given partitions only takes a partition column")
            df = self._like_last_write(df, path, partition_by)
            # One value per folder to be written.
            values = df.select(F.col(f"`{partition_by}`").cast("string").alias("v")).distinct()
            replaced = json.dumps(sorted((r["v"] for r in values.collect()),
                                         key=lambda v: (v is None, v or "")))
        if partition_by and not clustered:
            df = df.hint("rebalance", partition_by)
        counted = Observation()
        writer = df.observe(counted, F.count("*").alias("rows")).write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if only_given:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.format(self.format).mode("overwrite").save(path)
        rows = counted.get["rows"]
        if self.format == PARQUET:
            self._schemas[path] = df.schema
            self._note(path, partition_by, rows, df.schema.json(), replaced)
        return Written(path, self.format, rows)

    def _like_last_write(self, df: DataFrame, path: str, partition_by: str) -> DataFrame:
        """The rows with columns in the order of the table; an error if the table is built otherwise."""
        if self.format != PARQUET:
            return df
        last = (self.writes().filter(F.col("written_path") == path)
                .agg(F.max_by(F.struct("table_schema", "partition_by"), "written_at").alias("w"))
                .first())["w"]
        if last is None:
            return df
        if last["partition_by"] != partition_by:
            raise ValueError(f"{path} is partitioned by {last['partition_by']}, not {partition_by}")
        known = T.StructType.fromJson(json.loads(last["table_schema"]))
        given = {f.name: f.dataType for f in df.schema}
        if given != {f.name: f.dataType for f in known}:
            raise ValueError(f"columns of {path} are {known.simpleString()}, "
                             f"not {df.schema.simpleString()}")
        return df.select(*[F.col(f"`{name}`") for name in known.names])

    def writes(self) -> DataFrame:
        """All writes that were noted, by all runs that share the audit table."""
        return self.spark.read.schema(AUDIT_SCHEMA).parquet(self.audit_path)

    def _note(self, path: str, partition_by: str | None, rows: int, schema: str,
              replaced: str | None) -> None:
        row = (moment_column(dt.datetime.now(dt.timezone.utc)), self.run_id, path, self.format,
               partition_by, rows, schema, replaced)
        self.spark.range(0, 1, 1, 1).select(*[
            F.lit(value).cast(f.dataType).alias(f.name)
            for value, f in zip(row, AUDIT_SCHEMA.fields, strict=True)
        ]).write.mode("append").parquet(self.audit_path)

    def history(self, path: str) -> DataFrame:
        """The table's own history where it has one, else the writes noted for it."""
        if self.format == DELTA:
            return self.spark.sql("DESCRIBE HISTORY delta.`{}`".format(path.replace("`", "``")))
        return self.writes().filter(F.col("written_path") == path).drop("written_path")

    def history_audit(self, tables: dict[str, str], job_name: str,
                      moment: dt.datetime | None = None) -> DataFrame:
        """Histories of several tables (name -> path) as one tagged table."""
        moment = run_time(moment)
        tagged = [
            stamp(self.history(path), {"table_name": name, "table_path": path,
                                       "job_name": job_name, "captured_at_utc": moment})
            for name, path in tables.items()
        ]
        audit = tagged[0]
        for more in tagged[1:]:
            audit = audit.unionByName(more, allowMissingColumns=True)
        return audit


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back.

    For tables that several outputs are taken from: they are not computed again, and a lost
    executor costs no more than re-reading files.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Replace a plain Parquet output (quarantine, queues, rejects)."""
    df.write.mode("overwrite").parquet(path)


def write_report(one_row: DataFrame, path: str) -> None:
    """Replace a JSON report. It is a single aggregated row, so one file holds it."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Replace a CSV export with header, from which every text can be read back as it was.

    `one_file` is for results known to be small.
    """
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
