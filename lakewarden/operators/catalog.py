"""Catalog entries for a lake: databases with governance properties, tables found by folder."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.columns import named
from lakewarden.sources.store import staged


def _name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Spark keeps these names for itself; a governance property of that name is stored as data_<name>.
RESERVED = ("owner", "location", "comment")


def _properties(properties: Mapping[str, str]) -> str:
    named = {f"data_{k}" if k.lower() in RESERVED else k: v for k, v in properties.items()}
    return ", ".join(f"{_text(k)} = {_text(v)}" for k, v in named.items())


def create_database(spark: SparkSession, database: str, description: str = "",
                    properties: Mapping[str, str] | None = None,
                    location: str | None = None) -> None:
    """Create the database unless it exists; description and properties describe its governance."""
    place = f" LOCATION {_text(location)}" if location else ""
    props = f" WITH DBPROPERTIES ({_properties(properties)})" if properties else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_name(database)} COMMENT {_text(description)}"
              f"{place}{props}")


def update_database(spark: SparkSession, database: str, properties: Mapping[str, str]) -> None:
    spark.sql(f"ALTER DATABASE {_name(database)} SET DBPROPERTIES ({_properties(properties)})")


def describe_database(spark: SparkSession, database: str) -> DataFrame:
    """Name, description, location and properties as (info_name, info_value) rows."""
    return spark.sql(f"DESCRIBE DATABASE EXTENDED {_name(database)}")


@dataclass(frozen=True)
class Dataset:
    """A folder (or file) that is to be a table."""

    table: str
    path: str
    source: str = "parquet"


@dataclass(frozen=True)
class Registered:
    """What registering did: created, updated, unchanged, missing (logged, not dropped), conflict
    (files whose columns have types that no common type holds), or unreadable (no data file where the
    reader looks, as in folders that are no partitions). The last two leave the entry as it was."""

    table: str
    path: str
    outcome: str


KNOWN_SOURCES = ("parquet", "orc", "json", "csv")
_FORMAT_ENDING = re.compile(r"(?<=.)\.(" + "|".join((*KNOWN_SOURCES, "delta")) + r")\Z", re.IGNORECASE)


def _files_under(spark: SparkSession, *paths: str) -> DataFrame:
    """Path, size and time of the files under some folders; their content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .load(list(paths)).select("path", "length", "modificationTime"))


def _log_folders(spark: SparkSession, root: str) -> set[str]:
    """Datasets under the prefix that keep a table log."""
    try:
        logs = spark.read.format("binaryFile").load(f"{root}/*/_delta_log/*.json").select("path")
        rows = logs.select(F.regexp_extract("path", r"([^/]+)/_delta_log/", 1)).distinct().collect()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return set()
    return {r[0] for r in rows}


def _data_files(spark: SparkSession, root: str) -> DataFrame:
    """The data files under a prefix with the name of their dataset, the file ending, and whether the
    dataset is a folder."""
    prefix = root.split(":", 1)[-1].lstrip("/")
    below = F.regexp_extract("path", f"^[^:]*:?/*{re.escape(prefix)}/+(.*)$", 1)
    ending = F.regexp_extract(F.lower("path"), r"\.(" + "|".join(KNOWN_SOURCES)
                              + r")(?:\.[a-z0-9]+)?$", 1)
    return _files_under(spark, root).select(
        F.substring_index(below, "/", 1).alias("name"), ending.alias("source"),
        (F.instr(below, "/") > 0).alias("folder"), "path", "length", "modificationTime",
    ).where("source <> '' AND name <> ''")


def discover(spark: SparkSession, root: str) -> list[Dataset]:
    """The datasets directly under a prefix: folders with data files anywhere in them, and files.

    Only names are listed. The format is that of most files; what reaches the driver is one row per
    dataset and file ending.
    """
    root = root.rstrip("/")
    return _datasets(spark, root, _data_files(spark, root))


def _datasets(spark: SparkSession, root: str, files: DataFrame) -> list[Dataset]:
    counted = files.groupBy("name", "source", "folder").agg(F.count("*").alias("files")).collect()
    logs = _log_folders(spark, root)
    found = {}
    for r in sorted(counted, key=lambda r: (r["name"], -r["files"], r["source"])):
        found.setdefault(r["name"], r)
    tables = _table_names({name: r["folder"] for name, r in found.items()})
    return [Dataset(tables[name], f"{root}/{name}", "delta" if name in logs else r["source"])
            for name, r in found.items()]


def _table_names(folders: Mapping[str, bool]) -> dict[str, str]:
    """Table names, of letters, digits and underscores as Spark wants them, by name of file or folder.

    A file loses all from its first point on, a folder only a data format's ending (`orders.parquet`).
    Where that name is taken, the ending is kept, and after that a number is added.
    """
    found: dict[str, str] = {}
    taken: set[str] = set()
    for name, folder in folders.items():
        short = _FORMAT_ENDING.sub("", name) if folder else name.split(".")[0]
        whole, short = (re.sub(r"\W", "_", n, flags=re.ASCII) for n in (name, short or name))
        numbered = (f"{whole}_{i}" for i in itertools.count(2))
        found[name] = next(n for n in itertools.chain((short, whole), numbered) if n.lower() not in taken)
        taken.add(found[name].lower())  # Spark does not tell capitals in names
    return found


class FileList:
    """The files of a prefix as the last crawl found them: a table of path, size and time per file.

    Two slots are written in turn, so a crawl that ends early leaves the list before it in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.known = 0, None
        for slot in (0, 1):
            try:
                list_ = spark.read.parquet(f"{self.path}/slot{slot}")
            except AnalysisException as problem:
                if "PATH_NOT_FOUND" not in str(problem):
                    raise
                continue
            number = list_.agg(F.max("crawl")).first()[0] or 0
            if number > self.number:
                self.number, self.known = number, list_

    def changed(self, files: DataFrame) -> set[str] | None:
        """Names of datasets with new, changed or removed files; None if there is no list yet.

        What reaches the driver is one row per changed dataset.
        """
        if self.known is None:
            return None
        facts = ["name", "path", "length", "modificationTime"]
        now, before = files.select(*facts), self.known.where("path IS NOT NULL").select(*facts)
        # A file that is in one of the two lists only, or twice with unlike facts, is alone in its group.
        return {r["name"] for r in now.unionByName(before).groupBy(*facts).agg(F.count("*").alias("lists"))
                .where("lists = 1").select("name").distinct().collect()}

    def keep(self, files: DataFrame) -> None:
        """The list for the next crawl. One row without a path stands for the crawl itself."""
        number = self.number + 1
        mark = self.spark.range(0, 1, 1, 1).select(F.lit(number).cast("bigint").alias("crawl"))
        (files.withColumn("crawl", F.lit(number).cast("bigint")).unionByName(mark, allowMissingColumns=True)
         .write.mode("overwrite").parquet(f"{self.path}/slot{number % 2}"))


_OPTIONS = {"csv": " OPTIONS (header 'true')"}


def _partition_columns(opened: DataFrame, dataset: Dataset) -> list[str]:
    """Columns that come from folder names (Spark puts them last)."""
    folders = opened.select(F.input_file_name().alias("path")).where("path LIKE '%=%'").limit(1).collect()
    below = folders[0]["path"].rsplit(dataset.path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1] if folders else ""
    keys = [unquote(part.split("=", 1)[0]) for part in below.split("/")[:-1] if "=" in part]
    return [k for k in keys if k in opened.columns]


_WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_FRACTIONS = (T.FloatType(), T.DoubleType())


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that takes the values of both unchanged and that Parquet files of either are read as."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if all(t in _FRACTIONS or t in _WHOLE[:3] for t in (a, b)):  # a double holds every 32-bit number
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        precision = scale + max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(precision, scale) if precision <= 38 else None
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return wider_schema(a, b)
    return None


def wider_schema(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """The columns of both, each in its wider type; None if a column has none."""
    merged = {f.name.lower(): f for f in a}
    for f in b:
        known = merged.get(f.name.lower())
        data_type = wider_type(known.dataType, f.dataType) if known else f.dataType
        if data_type is None:
            return None
        merged[f.name.lower()] = T.StructField(known.name if known else f.name, data_type)
    return T.StructType(list(merged.values()))


def _widened(spark: SparkSession, dataset: Dataset) -> T.StructType | None:
    """The schema of Parquet files whose types Spark does not merge.

    Files in the order of their writing are halved until Spark can merge the schemas of a part, and
    the parts' schemas are widened. As types change with time, the parts are about as many as the changes
    times the logarithm of the number of files.
    """
    files = [r["path"] for r in _files_under(spark, dataset.path).where("path LIKE '%.parquet'")
             .orderBy("modificationTime", "path").select("path").collect()]
    reader = spark.read.option("mergeSchema", True).option("basePath", dataset.path)

    def merged(first: int, end: int) -> T.StructType | None:
        try:
            return reader.parquet(*files[first:end]).schema
        except (PySparkException, Py4JJavaError) as problem:
            if "CANNOT_MERGE" not in str(problem) or end - first < 2:
                raise
        middle = (first + end) // 2
        left = merged(first, middle)
        right = merged(middle, end) if left is not None else None
        return wider_schema(left, right) if right is not None else None

    return merged(0, len(files))


def _register(spark: SparkSession, database: str, dataset: Dataset) -> str:
    full = f"{_name(database)}.{_name(dataset.table)}"
    reader = spark.read.format(dataset.source)
    if dataset.source == "csv":
        reader = reader.option("header", True)
    elif dataset.source in ("parquet", "orc"):  # footers of all files, read by tasks
        reader = reader.option("mergeSchema", True)
    try:
        opened = reader.load(dataset.path)
    except AnalysisException as problem:
        if "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return "unreadable"
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return "missing"
    except (PySparkException, Py4JJavaError) as problem:  # a task found it, or the driver
        if "CANNOT_MERGE" not in str(problem):
            raise
        wide = _widened(spark, dataset) if dataset.source == "parquet" else None
        if wide is None:
            return "conflict"
        opened = spark.read.schema(wide).parquet(dataset.path)
    found = opened.schema
    outcome = "created"
    if spark.catalog.tableExists(full):
        before = {f.name: f.dataType for f in spark.table(full).schema}
        facts = _facts(spark, database, dataset.table)
        same = (before == {f.name: f.dataType for f in found}
                and _place(facts.get("Location")) == _place(dataset.path)
                and (facts.get("Provider") or "").lower() == dataset.source)
        outcome = "unchanged" if same else "updated"
        if outcome == "updated":
            spark.sql(f"DROP TABLE {full}")  # external: drops the entry, not the files
    if outcome != "unchanged":
        options = _OPTIONS.get(dataset.source, "")
        inside = _partition_columns(opened, dataset) if dataset.source in ("parquet", "orc") else None
        columns, parted = "", ""
        if inside is not None:  # the merged schema; left alone, one file would be asked for it
            columns = " (" + ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in found) + ")"
            if inside:
                parted = " PARTITIONED BY (" + ", ".join(_name(c) for c in inside) + ")"
        spark.sql(f"CREATE TABLE {full}{columns} USING {dataset.source}{options}{parted}"
                  f" LOCATION {_text(dataset.path)}")
    partitioned = spark.sql(f"DESCRIBE {full}").filter("col_name = '# Partition Information'")
    if dataset.source != "delta" and not partitioned.isEmpty():
        spark.catalog.recoverPartitions(full)
    spark.catalog.refreshTable(full)
    return outcome


def register_tables(spark: SparkSession, database: str,
                    datasets: Iterable[Dataset]) -> list[Registered]:
    """Register each dataset as an external table and follow changes of its schema, place or format.

    Data is never touched. A table whose path is gone stays registered and is reported.
    """
    return [Registered(d.table, d.path, _register(spark, database, d)) for d in datasets]


def crawl(spark: SparkSession, database: str, root: str, state: str | None = None) -> list[Registered]:
    """Register what lies under the prefix; report tables of the prefix that lost their folder.

    With `state`, a folder for the list of files, a later crawl opens only datasets whose files
    changed since; the others are reported as unchanged without a look at any footer.
    """
    root = root.rstrip("/")
    files = _data_files(spark, root)
    list_ = FileList(spark, state) if state else None
    if list_:
        files = staged(files, "files")
    found = _datasets(spark, root, files)
    changed = list_.changed(files) if list_ else None
    names = {r["tableName"] for r in list_tables(spark, database).collect()}

    def is_open(d: Dataset) -> bool:
        return changed is None or d.path.rsplit("/", 1)[-1] in changed or d.table not in names

    opened = {r.table: r for r in register_tables(spark, database, [d for d in found if is_open(d)])}
    done = [opened.get(d.table) or Registered(d.table, d.path, "unchanged") for d in found]
    inside = f"{root}/"
    for row in table_details(spark, database, sorted(names - {d.table for d in found})).collect():
        if row["location"] and inside in row["location"]:
            done.append(Registered(row["name"], row["location"], "missing"))
    if list_:
        refused = [d.path.rsplit("/", 1)[-1] for d in found if d.table in opened
                   and opened[d.table].outcome == "conflict"]
        # Datasets in conflict are looked at again, whether or not their files change.
        list_.keep(files.where(~F.col("name").isin(refused)) if refused else files)
    return done


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {_name(database)}").select("tableName")


def _place(path: str | None) -> str:
    """A location without the marks that a local path may come with or without."""
    return re.sub(r"^file:/*", "/", path or "").rstrip("/")


def _facts(spark: SparkSession, database: str, table: str) -> dict[str, str]:
    described = spark.sql(f"DESCRIBE FORMATTED {_name(database)}.{_name(table)}")
    return {r["col_name"]: r["data_type"] for r in described.filter(
        F.col("col_name").isin("Location", "Provider")).collect()}


def table_details(spark: SparkSession, database: str, tables: list[str]) -> DataFrame:
    """Name, location and format of registered tables."""
    rows = []
    for table in tables:
        facts = _facts(spark, database, table)
        rows.append((table, facts.get("Location"), facts.get("Provider")))
    return spark.createDataFrame(rows, "name string, location string, format string")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: its type, the table's rows, and how many of them are NULL there.

    One aggregation over the table.
    """
    counted = df.agg(F.count("*").alias("__rows"), *[
        F.count(named(c)).alias(f"__c{i}") for i, c in enumerate(df.columns)
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                 F.col("__rows").alias("row_count"),
                 (F.col("__rows") - F.col(f"__c{i}")).alias("null_count"))
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return counted.select(F.inline(entries))


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """As `profile`, for Parquet files: counts of flat columns come from the files' footers.

    Only lists, maps and structs, of which footers do not count the NULLs, are read. Every file
    needs statistics in its footer, as Spark and other writers put there by default; for files
    without them take `profile`.
    """
    sources = "spark.sql.sources.useV1SourceList"
    given = spark.conf.get(sources)
    try:
        # The newer reader takes aggregates from footers; a table keeps the reader it was opened by.
        spark.conf.set(sources, ",".join(s for s in given.split(",") if s.strip() != "parquet"))
        by_footer = spark.read.parquet(path)
    finally:
        spark.conf.set(sources, given)
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [f.name for f in by_footer.schema.fields if not isinstance(f.dataType, nested)]
    deep = [c for c in by_footer.columns if c not in flat]
    parts = [profile(by_footer.select(*[named(c) for c in flat]))] if flat else []
    if deep:
        parts.append(profile(spark.read.parquet(path).select(*[named(c) for c in deep])))
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows; with an order, Spark keeps only the best n per task."""
    return (df.orderBy(*order) if order else df).limit(n)
