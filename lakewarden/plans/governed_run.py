"""The five stages in order, handing tables over by path."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakewarden import fixed_values as fv
from lakewarden.config import (
    Contract,
    Lifecycle,
    MatchConfig,
    QualityConfig,
    load_document,
)
from lakewarden.functions.columns import run_time
from lakewarden.operators import audit, conform, enrich, quality
from lakewarden.operators import match_exact as exact
from lakewarden.session import with_settings
from lakewarden.sources.readers import ZONE_SCHEMA, read_csv, read_parquet
from lakewarden.sources.store import TableStore, staged, write_parquet, write_report

STAGES = ("conform", "enrich", "quality", "match", "audit")


def run_settings(spark: SparkSession) -> dict[str, str]:
    """What every stage reads and writes its tables with."""
    return {
        # Several tasks a core, so that cores do not wait for the one with the most rows.
        "spark.sql.files.minPartitionNum": str(4 * spark.sparkContext.defaultParallelism),
        # Rows of a task go to a file per partition value as they come; beyond so many they are sorted.
        "spark.sql.maxConcurrentOutputFileWriters": "8",
        # Times as 64-bit numbers, not as the 12 bytes that old readers want.
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }


@dataclass(frozen=True)
class Artifacts:
    """What governs a run."""

    contract: Contract
    quality: QualityConfig
    match: MatchConfig
    lifecycle: Lifecycle

    @classmethod
    def load(cls, spark: SparkSession, paths: Mapping[str, str], *,
             min_pass_rate: float | None = None, high: float | None = None,
             medium: float | None = None) -> Artifacts:
        """Read the four documents; explicit numbers go before those in the documents."""
        return cls(
            Contract.parse(load_document(spark, paths["metadata"])),
            QualityConfig.parse(load_document(spark, paths["quality"]), min_pass_rate),
            MatchConfig.parse(load_document(spark, paths["match"]), high, medium),
            Lifecycle.parse(load_document(spark, paths["lifecycle"])),
        )


@dataclass(frozen=True)
class Places:
    """Where inputs lie and outputs go."""

    raw_trips: str
    raw_zones: str
    validated: str
    curated: str
    passed: str
    rejects: str
    quality_report: str
    master: str
    steward_queue: str
    match_rejects: str
    match_audit: str
    orphans: str
    lifecycle: str
    history: str
    summary: str
    commits: str

    def __post_init__(self):
        for name, path in vars(self).items():
            if not isinstance(path, str) or not path.strip():
                raise ValueError(f"the path {name} is empty")
            object.__setattr__(self, name, path.strip().rstrip("/"))

    @classmethod
    def under(cls, root: str, raw_trips: str, raw_zones: str) -> Places:
        outputs = [n for n in cls.__dataclass_fields__ if not n.startswith("raw_")]
        return cls(raw_trips, raw_zones, **{n: f"{root}/{n}" for n in outputs})


@dataclass
class GovernedRun:
    spark: SparkSession
    places: Places
    artifacts: Artifacts
    job_name: str
    conform_plan: conform.ConformPlan = conform.ConformPlan()
    # Set to check the rules that fit the table's columns instead of the configured ones.
    auto_rules: quality.AutoRules | None = None
    # Column the validated and curated tables are partitioned by; the start date if not named.
    partition_by: str | None = None
    moment: dt.datetime | None = None
    table_format: str | None = None

    def __post_init__(self):
        self.moment = run_time(self.moment)
        self.partition_by = self.partition_by or self.conform_plan.date_name
        self.store = TableStore(self.spark, self.places.commits, format=self.table_format)

    def run(self, mode: str = "all") -> None:
        """All stages, or one by its name. An unknown mode is an error."""
        wanted = mode.strip().lower()
        wanted = fv.RUN_MODE_ALIASES.get(wanted, wanted)
        if wanted != "all" and wanted not in STAGES:
            raise ValueError(f"unknown mode {mode!r}; known are all, {', '.join(STAGES)}")
        with with_settings(self.spark, run_settings(self.spark)):
            for stage in STAGES if wanted == "all" else (wanted,):
                getattr(self, f"stage_{stage}")()

    def _zones(self) -> DataFrame:
        return read_csv(self.spark, self.places.raw_zones, ZONE_SCHEMA)

    def stage_conform(self) -> None:
        raw = read_parquet(self.spark, self.places.raw_trips)
        valid = conform.conform(raw, self.artifacts.contract, self.conform_plan,
                                moment=self.moment)
        self.store.write(valid, self.places.validated, partition_by=self.partition_by)

    def stage_enrich(self) -> None:
        """With a small dimension no row changes its task, so rows stay clustered as they were
        stored and the partitioned write needs no shuffle."""
        valid, zones = self.store.read(self.places.validated), self._zones()
        size = enrich.dimension_size(valid, zones)
        curated = enrich.enrich(valid, zones, size=size, moment=self.moment)
        self.store.write(curated, self.places.curated, partition_by=self.partition_by,
                         clustered=size is None or size.fits())

    def stage_quality(self) -> None:
        """Two narrow passes over the curated table, then a report over what they wrote."""
        places, config = self.places, self.artifacts.quality
        curated, rules = self.store.read(places.curated), config.rules
        if self.auto_rules is not None:
            rules = quality.derive_rules(curated, self.auto_rules)
        flagged = quality.add_flags(curated, rules, list_failed=self.auto_rules is None)
        self.store.write(quality.passed(flagged), places.passed)
        write_parquet(quality.quarantined(flagged), places.rejects)
        summary = quality.report_of_outputs(
            self.store.read(places.passed), read_parquet(self.spark, places.rejects), rules,
            {"job_name": self.job_name, "input_path": places.curated,
             "curated_out_path": places.passed, "rejects_path": places.rejects,
             "generated_at_utc": self.moment},
        )
        row = summary.first()  # one aggregated row, computed once for the report and the gate
        write_report(self.spark.createDataFrame([row], summary.schema), places.quality_report)
        quality.enforce(float(row["pass_rate"]), config.policy,
                        f"Rejects: {places.rejects}, report: {places.quality_report}")

    def stage_match(self) -> None:
        places, config = self.places, self.artifacts.match
        # Four outputs are taken from the scored records, so these are computed once.
        scored = staged(exact.match_exact(self._zones(), config), "scored-records")
        self.store.write(exact.exact_master(scored, fv.ZONE_KEY, moment=self.moment),
                         places.master)
        write_parquet(exact.review_records(scored, moment=self.moment), places.steward_queue)
        write_parquet(exact.rejected_records(scored, moment=self.moment), places.match_rejects)
        write_report(
            exact.exact_audit(scored, config.thresholds, {
                "raw_zones_path": places.raw_zones, "master_out_path": places.master,
                "generated_at_utc": self.moment,
            }), places.match_audit)

    def stage_audit(self) -> None:
        places, name = self.places, self.job_name
        master, facts = self.store.read(places.master), self.store.read(places.passed)
        found = audit.stamp_orphans(audit.orphans(facts, master), name, self.moment)
        written = self.store.write(found, places.orphans)
        self.store.write(
            audit.lifecycle_snapshot(master, self.artifacts.lifecycle.states, name, self.moment),
            places.lifecycle)
        self.store.write(
            self.store.history_audit({fv.MASTER_TABLE: places.master,
                                      fv.FACT_TABLE: places.passed}, name, self.moment),
            places.history)
        self.store.write(
            audit.run_summary(self.spark, {
                "audit_history_out_path": places.history,
                "curated_trips_path": places.passed,
                "job_name": name,
                "lifecycle_snapshot_path": places.lifecycle,
                "master_zones_path": places.master,
                "orphans_count": written.rows,
                "orphans_out_path": places.orphans,
            }, self.moment), places.summary)
