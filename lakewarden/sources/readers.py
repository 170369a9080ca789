"""Readers for raw inputs, reports and logs."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import fixed_values as fv
from lakewarden.functions.columns import named, require_columns

ZONE_SCHEMA = T.StructType([
    T.StructField(fv.ZONE_KEY, T.IntegerType()),
    T.StructField(fv.ZONE_AREA, T.StringType()),
    T.StructField(fv.ZONE_NAME, T.StringType()),
    T.StructField(fv.ZONE_SERVICE, T.StringType()),
])

def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One file, a folder of part files, or several of either read as one table.

    Of several, the columns are those of all; where a file lacks one, it is NULL. That takes the footers of
    all files, read by tasks.
    """
    return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)


# How this library writes and reads CSV: nothing is trimmed, quotes are doubled, an empty text is a
# pair of quotes and NULL is nothing at all.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": '""',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


WRONG_FIELDS = "wrong number of fields"
_LINE, _PROBLEMS, _FILE, _TEXT = "__line", "__problems", "__file", "__text"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header line, matched to the schema by name; malformed values become NULL.

    Fields are read as text under the names the header gives and cast after that, because a
    schema handed to the reader is matched by position. Texts with line feeds in them need
    `multi_line`; a file is then read by one task.
    """
    # A field without quotes and without content is handed over as the mark, and so is NULL.
    options = CSV_OPTIONS | {"emptyValue": "", "nullValue": "\0",
                             "multiLine": str(multi_line).lower()}
    raw = spark.read.options(**options).csv(path)
    require_columns(raw, schema.names, path)
    return raw.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, *,
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """As `read_csv`, but lines with a field that fails its cast are kept apart: (good, quarantined).

    Quarantined lines have `file`, `line` (the text of the line), and `problems`, an array of (column,
    reason): a field that is no value of its type, or a line with more or fewer fields than the header,
    whose column is NULL. A field without content is a missing value, not a problem. Every line is in one
    of the two. Where only casts failed the line is put together again from its fields, so quotes that
    the reader did not need are left out.
    """
    options = CSV_OPTIONS | {"emptyValue": "", "nullValue": "\0",
                             "multiLine": str(multi_line).lower()}
    header = spark.read.options(**options).csv(path).columns
    require_columns(spark.createDataFrame([], T.StructType(
        [T.StructField(c, T.StringType()) for c in header])), schema.names, path)
    # Columns that are not asked for are parsed too: else a line with too few fields goes unnoticed.
    whole = T.StructType([T.StructField(c, T.StringType()) for c in (*header, _LINE)])
    raw = spark.read.schema(whole).options(
        **options, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, columnPruning="false").csv(path)
    problems = [F.when(F.col(_LINE).isNotNull(), F.struct(
        F.lit(None).cast("string").alias("column"), F.lit(WRONG_FIELDS).alias("reason")))]
    for f in schema.fields:
        failed = (F.col(_LINE).isNull() & named(f.name).isNotNull()
                  & named(f.name).try_cast(f.dataType).isNull())
        problems.append(F.when(failed, F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f"not a value of type {f.dataType.simpleString()}").alias("reason"))))
    fields = F.struct(*[named(c) for c in header])
    again = F.to_csv(fields, {"quote": '"', "escape": '"', "emptyValue": '""',
                              "ignoreLeadingWhiteSpace": "false",
                              "ignoreTrailingWhiteSpace": "false"})
    checked = raw.select(
        F.array_compact(F.array(*problems)).alias(_PROBLEMS),
        F.col("_metadata.file_path").alias(_FILE),
        F.coalesce(named(_LINE), again).alias(_TEXT),
        *[named(c) for c in schema.names])
    good = checked.where(F.size(_PROBLEMS) == 0).select(
        [named(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    bad = checked.where(F.size(_PROBLEMS) > 0).select(
        F.col(_FILE).alias("file"), F.col(_TEXT).alias("line"), F.col(_PROBLEMS).alias("problems"))
    return good, bad


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line and guessed types. Costs one more pass over the file."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_json_lines(spark: SparkSession, path: str,
                    schema: T.StructType | None = None) -> DataFrame:
    """JSON report, one record per line; a schema saves the inference pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_small_text(spark: SparkSession, path: str) -> str:
    """Configuration files as one string: all files of the path, by name."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("file"))
    return "\n".join(r["value"] for r in files.orderBy("file").collect())


def read_optional(read: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
    """Try a look-up input that a job can do without: (table, None) or (None, reason).

    Opening the table and fetching one row is enough to know that it can be read.
    """
    try:
        df = read()
        df.isEmpty()
    except (PySparkException, Py4JJavaError) as problem:
        return None, str(problem)
    return df, None
