"""CSV files with line feeds inside fields, each read by as many tasks as it has splits.

Spark cuts a file into splits and ends each at a line. Whether a line begins a record depends on the
quotes before it, back to the start of the file: it does if their number is even. So the quotes of every
split are counted; sums over the splits of a file, one small row each, tell every split whether it begins
inside quotes. Tasks then read their splits again, line after line, and put the lines of a record
together as they come. Only the parts of records that cross the end of a split are sorted by place and
leave their task; no line by itself does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.columns import require_columns
from lakewarden.session import ship_package, with_settings
from lakewarden.sources.readers import CSV_OPTIONS
from lakewarden.sources.store import staged

_NAMED = 5  # files named in an error
_BATCH_BYTES = 16 << 20  # of lines that go to Python at a time
_SPLIT = ["file", "split", "length"]
# As read by tasks: `record` is a whole record, `part` the part of one that crosses the end of its split.
_PIECES = "id bigint, local bigint, record binary, part binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split; a task takes its splits one by one, each in the order of the file."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_block_length").alias("length"), "value")


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: its id, whether it begins and ends inside quotes, and whether it is its file's last."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    in_file = Window.partitionBy("file").orderBy("split")
    before = F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    return lines.groupBy(*_SPLIT).agg(F.sum(quotes).alias("quotes")).withColumns({
        "begins_inside": F.coalesce(before, F.lit(0)) % 2,
        "is_last": F.lead("split").over(in_file).isNull()}).select(
            *_SPLIT, F.monotonically_increasing_id().alias("id"), "begins_inside",
            ((F.col("begins_inside") + F.col("quotes")) % 2).alias("ends_inside"), "is_last")


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines from each start up to the next, or to the end, as one value."""
    offsets = pa.array(np.append(starts, len(lines)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n").cast(pa.binary())


class _OpenSplit:
    """A split whose lines are being read; holds the lines of the record that is not yet ended."""

    def __init__(self, id_: int, inside: int):
        self.id, self.inside = id_, inside
        self.local = 0  # of the record that is held: 0 for one that began in an earlier split
        self.held: list[pa.Array] = []

    def _held(self) -> pa.Array:
        return _joined(pa.concat_arrays(self.held), np.zeros(1, dtype=np.int32))

    def _batch(self, first: int, values: pa.Array, cross: bool) -> pa.RecordBatch:
        n, none = len(values), pa.nulls(len(values), pa.binary())
        return pa.record_batch([
            pa.array(np.full(n, self.id), pa.int64()), pa.array(np.arange(first, first + n), pa.int64()),
            none if cross else values, values if cross else none], [c.split()[0] for c in _PIECES.split(", ")])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        up_to = self.inside + np.cumsum(quotes)
        starts = np.flatnonzero((up_to - quotes) % 2 == 0)
        self.inside = int(up_to[-1] % 2)
        if not len(starts):
            self.held.append(lines)
            return
        if starts[0]:
            self.held.append(lines[:starts[0]])
        if self.held:
            yield self._batch(self.local, self._held(), self.local == 0)
        if len(starts) > 1:
            ended = lines[starts[0]:starts[-1]]
            yield self._batch(self.local + 1, _joined(ended, starts[:-1] - starts[0]), False)
        self.local += len(starts)
        self.held = [lines[starts[-1]:]]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._batch(self.local, self._held(), self.local == 0 or self.inside == 1)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column("id").null_count:
            raise RuntimeError("the files, or how they are split, changed while they were read")
        ids = batch.column("id").to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if split is None or split.id != ids[a]:
                if split is not None:
                    yield from split.end()
                split = _OpenSplit(int(ids[a]), batch.column("begins_inside")[a].as_py())
            yield from split.add(batch.column("line")[a:b])
    if split is not None:
        yield from split.end()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1 in each file, the header is 1), record: the text of each record.

    Quotes are doubled inside quoted fields and stand nowhere else, as `write_csv` has it; a file that
    ends inside quotes is refused. Records end with a line feed, before which a carriage return may
    stand. Lines without content outside quotes are no records, but have a number. No files' lines:
    no rows.
    """
    ship_package(spark)
    settings = {
        # Both readings cut the files alike, even if executors come or go in between.
        "spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(_BATCH_BYTES),
    }
    with with_settings(spark, settings):
        lines = _lines(spark, path)
        splits = staged(_splits(lines), "csv-splits")  # one row per split
        broken = splits.where("is_last AND ends_inside = 1").select("file").limit(_NAMED).collect()
        if broken:
            raise ValueError("files that end inside quotes: " + ", ".join(r["file"] for r in broken))
        # The splits are broadcast, so lines stay in their task and order.
        placed = lines.join(F.broadcast(splits.select(*_SPLIT, "id", "begins_inside")), _SPLIT, "left")
        pieces = staged(placed.select("id", "begins_inside", F.col("value").cast("binary").alias("line"))
                        .mapInArrow(_pieces, _PIECES), "csv-pieces")

    begun = pieces.groupBy("id").agg(F.max("local").alias("begun"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    places = F.broadcast(staged(splits.join(begun, "id").select(
        "id", "file", "split", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("begun_before")),
        "csv-places"))
    number = (F.col("begun_before") + F.col("local")).alias("number")
    whole = pieces.where("record IS NOT NULL").join(places, "id").select(
        "file", number, F.col("record").cast("string").alias("line"))
    parts = pieces.where("part IS NOT NULL").select("id", "local", "part").join(places, "id").select(
        "file", number, "split", F.col("part").cast("string").alias("line"))
    held = F.array_sort(F.collect_list(F.struct("split", "line")))
    crossing = parts.groupBy("file", "number").agg(F.array_join(held["line"], "\n").alias("line"))
    text = F.when(F.endswith("line", F.lit("\r")), F.expr("substring(line, 1, length(line) - 1)")).otherwise(
        F.col("line"))
    return whole.unionByName(crossing).select("file", "number", text.alias("record")).where("record <> ''")


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As `readers.read_csv` with `multi_line`, but a large file is read by many tasks.

    All files have the header of the first one. See `csv_records` for what a record is.
    """
    options = CSV_OPTIONS | {"emptyValue": "", "nullValue": "\0", "multiLine": "true"}
    header = spark.read.options(**options).csv(path).columns
    require_columns(spark.createDataFrame([], T.StructType(
        [T.StructField(c, T.StringType()) for c in header])), schema.names, path)
    # Fields are parsed by position, so that headers with odd letters need no quoting.
    fields = ", ".join(f"f{i} string" for i in range(len(header)))
    parsed = csv_records(spark, path).where("number > 1").select(
        F.from_csv("record", fields, {k: v for k, v in options.items() if k != "header"}).alias("r"))
    return parsed.select([F.col(f"r.f{header.index(f.name)}").try_cast(f.dataType).alias(f.name)
                          for f in schema.fields])
