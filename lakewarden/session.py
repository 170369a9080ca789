"""Spark session settings and the shared folder that jobs may write work files to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and epoch seconds must not depend on the machine.
    "spark.sql.session.timeZone": "UTC",
    # Run-time plans: coalesce small partitions, split skewed ones, switch to broadcast.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Work folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}
_shipped: set[str] = set()  # applications whose executors have this package


def build_session(app_name: str = "lakewarden", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Bring a session that someone else started to the settings results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Tables partitioned by date have many folders; listing them takes few tasks, not one each.
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
    # A shuffled join side whose partitions all turn out small is hashed instead of sorted.
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    # Counts over Parquet files opened by the newer reader come from the footers.
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark


@contextmanager
def with_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the queries that run inside; those from before come back after."""
    given = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in given.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster is no local session
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="lakewarden-")
    return _LOCAL_FOLDERS[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Once per application: the package as a zip file, served to executors by Spark itself.

    Python workers import the functions they run from it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
