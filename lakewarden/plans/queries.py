"""Every operator as a query over the test tables, next to the same question in ANSI SQL."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import fixed_values as fv
from lakewarden.config import (
    Contract,
    Lifecycle,
    MatchConfig,
    QualityConfig,
    QualityPolicy,
    Rule,
    Thresholds,
)
from lakewarden.functions.columns import minutes_between
from lakewarden.functions.matching import normalized
from lakewarden.operators import audit, catalog, conform, enrich, golden, quality, ranked_pairs
from lakewarden.operators import match_exact as exact
from lakewarden.operators import match_pairs as mp
from lakewarden.plans.governed_run import Artifacts, GovernedRun, Places
from lakewarden.plans.pair_matching import PairMatching
from lakewarden.plans.star_tables import (
    TABLES,
    TRIPS_SQL,
    ZONES_SQL,
    parts,
    table,
    trips,
    zones,
)
from lakewarden.session import fresh_path, shared_folder
from lakewarden.sources.csv_records import read_csv_records
from lakewarden.sources.readers import (
    read_csv,
    read_csv_checked,
    read_csv_inferred,
    read_json_lines,
    read_optional,
    read_parquet,
)
from lakewarden.sources.store import TableStore, staged, write_csv, write_parquet, write_report

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None) -> Callable[[Run], Run]:
    """Register the decorated function under its own name."""
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run, sql)
        return run
    return add


# Columns that hold the time of the run or a zoned time; SQL cannot reproduce these.
CLOCK = ("ingested_at", "curated_at", "created_at_utc", "updated_at_utc", "submitted_at_utc",
         "rejected_at_utc", "detected_at_utc", "snapshot_at_utc", "generated_at_utc",
         "captured_at_utc", fv.START_TS, fv.END_TS)


def timeless(df: DataFrame) -> DataFrame:
    return df.drop(*CLOCK)


# ---------------------------------------------------------------- conform

CONTRACT = Contract(source="SAMPLE", dataset_name="trips", classification="internal",
                    types={"VendorID": "int", "fare_amount": "double", "unknown": "double"})

STAMPED = """'validated' AS governance_zone, 'SAMPLE' AS source_system,
 'trips' AS dataset_name, 'internal' AS classification"""


@query(f"""WITH {TRIPS_SQL}
SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date, {STAMPED} FROM trips
WHERE dropoff_datetime >= pickup_datetime AND fare_amount >= 0 AND total_amount >= 0
  AND trip_distance >= 0 AND passenger_count >= 0""")
def conform_gates(spark: SparkSession, folder: str) -> DataFrame:
    return timeless(conform.conform(trips(spark, folder), CONTRACT))


@query(f"""WITH {TRIPS_SQL}
SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date, {STAMPED} FROM trips
WHERE dropoff_datetime >= pickup_datetime AND fare_amount > 0""")
def conform_positive_measure(spark: SparkSession, folder: str) -> DataFrame:
    return timeless(conform.conform(trips(spark, folder), CONTRACT, conform.POSITIVE_FARE_PLAN))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  o_orderstatus, TRY_CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority
    ELSE regexp_extract(o_orderpriority, '^([0-9]+)', 1) END AS INTEGER) AS priority
FROM orders""")
def conform_cast_contract(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(
        F.regexp_extract("o_orderpriority", "^([0-9]+)", 1))
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", text.alias("priority"))
    contract = Contract(types={"o_orderkey": "string", "o_custkey": "double", "priority": "int"})
    return conform.align_types(orders, contract)


@query(f"""WITH {TRIPS_SQL}
SELECT l_orderkey, l_linenumber,
  CAST(CAST(floor(epoch(dropoff_datetime)) AS BIGINT)
       - CAST(floor(epoch(pickup_datetime)) AS BIGINT) AS DOUBLE) / CAST(60 AS DOUBLE)
    AS trip_duration_min
FROM trips""")
def event_duration(spark: SparkSession, folder: str) -> DataFrame:
    minutes = minutes_between(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    return trips(spark, folder).select(
        "l_orderkey", "l_linenumber", minutes.alias(fv.DURATION_MIN))


@query("""SELECT event_type, CAST(ts AS DATE) AS event_date, count(*) AS events,
  max(CAST(CAST(floor(epoch(ts)) AS BIGINT) - epoch(date_trunc('day', ts)) AS DOUBLE)
      / CAST(60 AS DOUBLE)) AS last_minute
FROM events GROUP BY ALL""")
def event_minutes_of_day(spark: SparkSession, folder: str) -> DataFrame:
    """Times with fractions of a second: endpoints are floored to whole seconds."""
    events = table(spark, folder, "events")
    since_midnight = minutes_between(F.date_trunc("day", "ts"), F.col("ts"))
    return events.groupBy("event_type", F.to_date("ts").alias("event_date")).agg(
        F.count("*").alias("events"), F.max(since_midnight).alias("last_minute"))


# ---------------------------------------------------------------- enrich

ROLE_SQL = """
curated AS (
  SELECT t.*, pu.Zone AS pu_zone, pu.Borough AS pu_borough, pu.service_zone AS pu_service_zone,
         d.Zone AS do_zone, d.Borough AS do_borough, d.service_zone AS do_service_zone
  FROM trips t LEFT JOIN zones pu ON t.PULocationID = pu.LocationID
  LEFT JOIN zones d ON t.DOLocationID = d.LocationID
)"""


def curated_trips(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.add_roles(trips(spark, folder), zones(spark, folder))


@query(f"""WITH {TRIPS_SQL}, {ZONES_SQL}, {ROLE_SQL}
SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date, 'curated' AS governance_zone,
  'SAMPLE' AS source_system, 'trips' AS dataset_name, 'internal' AS classification,
  CAST(epoch(dropoff_datetime) - epoch(pickup_datetime) AS DOUBLE) / CAST(60 AS DOUBLE)
    AS trip_duration_min
FROM curated
WHERE dropoff_datetime >= pickup_datetime AND fare_amount >= 0 AND total_amount >= 0
  AND trip_distance >= 0 AND passenger_count >= 0""")
def enrich_role_playing(spark: SparkSession, folder: str) -> DataFrame:
    valid = conform.conform(trips(spark, folder), CONTRACT)
    return timeless(enrich.enrich(valid, zones(spark, folder)))


@query("""SELECT o.*, c.c_custkey AS buyer_key, c.c_name AS buyer_name, c.c_mktsegment AS buyer_segment
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c
  ON o.o_custkey = c.c_custkey""")
def enrich_unmatched_left(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in debt are not in the dimension, so their orders keep NULL attributes."""
    in_credit = table(spark, folder, "customer").filter("c_acctbal >= 0")
    dimension = enrich.Dimension("c_custkey", {"c_name": "name", "c_mktsegment": "segment"})
    return enrich.add_roles(table(spark, folder, "orders"), in_credit,
                            [enrich.Role("o_custkey", "buyer")], dimension, keep_key_as="key")


# ---------------------------------------------------------------- quality

RULES = (
    Rule("vendor_known", "VendorID IS NOT NULL"),
    Rule("fare_not_negative", "fare_amount >= 0"),
    Rule("ends_after_start", "dropoff_datetime >= pickup_datetime"),
    Rule("rate_code_valid", "RatecodeID BETWEEN 1 AND 6"),
    Rule("places_known", "pu_zone IS NOT NULL AND do_zone IS NOT NULL"),
    # NULL for code 3: a rule without an answer counts as failed.
    Rule("total_over_code", "total_amount / nullif(RatecodeID - 3, 0) > 0"),
)

FLAGS_SQL = ", ".join(f"coalesce({r.sql}, false) AS {r.name}" for r in RULES)
PASS_SQL = " AND ".join(r.name for r in RULES)
FAILED_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN NOT {r.name} THEN '{r.name}' END" for r in RULES) + ")"
DQ_SQL = f"""WITH {TRIPS_SQL}, {ZONES_SQL}, {ROLE_SQL},
flagged AS (SELECT *, {FLAGS_SQL} FROM curated),
checked AS (SELECT *, ({PASS_SQL}) AS dq_pass, {FAILED_SQL} AS failed_rules FROM flagged)
"""
FAIL_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (WHERE NOT {r.name}) AS {r.name}_fail_count" for r in RULES)
REPORT_SQL = DQ_SQL + f"""SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE dq_pass) AS passed_rows, count(*) FILTER (WHERE NOT dq_pass) AS failed_rows,
  {FAIL_COUNTS_SQL},
  CAST(count(*) FILTER (WHERE dq_pass) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pass_rate
FROM checked"""


def flagged_trips(spark: SparkSession, folder: str) -> DataFrame:
    return quality.add_flags(curated_trips(spark, folder), RULES)


def _joined_names(df: DataFrame) -> DataFrame:
    return df.withColumn(quality.FAILED, F.array_join(quality.FAILED, ","))


@query(DQ_SQL + f"SELECT l_orderkey, l_linenumber, {', '.join(r.name for r in RULES)}, dq_pass "
       "FROM checked")
def dq_flags(spark: SparkSession, folder: str) -> DataFrame:
    return flagged_trips(spark, folder).select(
        "l_orderkey", "l_linenumber", *[r.name for r in RULES], quality.PASS)


@query(DQ_SQL + "SELECT * EXCLUDE (dq_pass) FROM checked WHERE dq_pass")
def dq_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _joined_names(quality.passed(flagged_trips(spark, folder)))


@query(DQ_SQL + "SELECT * FROM checked WHERE NOT dq_pass")
def dq_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return _joined_names(quality.quarantined(flagged_trips(spark, folder)))


@query(DQ_SQL + "SELECT l_orderkey, l_linenumber, failed_rules FROM checked")
def dq_failed_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _joined_names(flagged_trips(spark, folder).select(
        "l_orderkey", "l_linenumber", quality.FAILED))


@query(REPORT_SQL)
def dq_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(flagged_trips(spark, folder), RULES)


@query(REPORT_SQL)
def dq_report_of_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The report as the governed run makes it: over the written tables, through a JSON file."""
    root = fresh_path(spark, "dq")
    flagged = flagged_trips(spark, folder)
    write_parquet(quality.passed(flagged), f"{root}/passed")
    write_parquet(quality.quarantined(flagged), f"{root}/rejects")
    row = quality.report_of_outputs(
        read_parquet(spark, f"{root}/passed"), read_parquet(spark, f"{root}/rejects"), RULES)
    write_report(row, f"{root}/report")
    return read_json_lines(spark, f"{root}/report", row.schema)


@query(DQ_SQL + " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule_id, count(*) AS checked_rows, "
    f"count(*) FILTER (WHERE NOT {r.name}) AS fail_count FROM checked" for r in RULES))
def dq_rule_fail_long(spark: SparkSession, folder: str) -> DataFrame:
    return quality.fail_counts_long(flagged_trips(spark, folder), RULES)


AUTO_SQL = {
    "vendor_not_null": "VendorID IS NOT NULL",
    "pu_location_not_null": "PULocationID IS NOT NULL",
    "do_location_not_null": "DOLocationID IS NOT NULL",
    "pickup_not_null": "pickup_datetime IS NOT NULL",
    "dropoff_not_null": "dropoff_datetime IS NOT NULL",
    "pickup_before_dropoff": "pickup_datetime <= dropoff_datetime",
    "trip_distance_non_negative": "trip_distance >= 0",
    "fare_amount_non_negative": "fare_amount >= 0",
    "total_amount_non_negative": "total_amount >= 0",
    "tip_amount_non_negative": "tip_amount >= 0",
    "tolls_amount_non_negative": "tolls_amount >= 0",
    "extra_non_negative": "extra >= 0",
    "passenger_count_range": "passenger_count BETWEEN 0 AND 8",
    "ratecode_range": "RatecodeID BETWEEN 1 AND 6",
}


@query(f"WITH {TRIPS_SQL} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule_id, count(*) AS checked_rows, "
    f"count(*) FILTER (WHERE NOT ({test})) AS fail_count FROM trips"
    for name, test in AUTO_SQL.items()))
def dq_auto_rules(spark: SparkSession, folder: str) -> DataFrame:
    raw = trips(spark, folder)
    rules = quality.derive_rules(raw)
    return quality.fail_counts_long(quality.add_flags(raw, rules, list_failed=False), rules)


DOCUMENT_RULES = (
    Rule("length_as_stated", "length(text) = n_chars"),
    Rule("not_blank", "length(trim(text)) > 0"),
    Rule("single_line", "strpos(text, chr(10)) = 0"),
    Rule("no_address", "strpos(text, '@') = 0"),
)


@query("WITH f AS (SELECT source, " + ", ".join(
    f"({r.sql}) AS {r.name}" for r in DOCUMENT_RULES) + " FROM documents) "
    "SELECT source, count(*) AS total_rows, " + ", ".join(
        f"count(*) FILTER (WHERE NOT {r.name}) AS {r.name}_fail_count" for r in DOCUMENT_RULES)
    + " FROM f GROUP BY source")
def dq_documents_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Rules over whole texts, counted per source."""
    rules = [Rule(r.name, r.sql.replace("strpos", "instr")) for r in DOCUMENT_RULES]
    flagged = quality.add_flags(table(spark, folder, "documents"), rules, list_failed=False)
    return flagged.groupBy("source").agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(~F.col(r.name)).alias(f"{r.name}_fail_count") for r in rules])


# ---------------------------------------------------------------- matching by key

EXACT = MatchConfig("concat_ws('::', upper(p_brand), upper(p_name))")
STRICT = MatchConfig(EXACT.key_sql, Thresholds(0.95, 0.90))
EXACT_SQL = """
keyed AS (
  SELECT p_partkey, p_name, p_brand, p_type,
         concat_ws('::', upper(p_brand), upper(p_name)) AS match_key FROM part
),
sized AS (SELECT *, count(*) OVER (PARTITION BY match_key) AS dupe_count FROM keyed),
scored AS (
  SELECT *, CASE WHEN dupe_count = 1 THEN CAST(0.99 AS DOUBLE) ELSE CAST(0.88 AS DOUBLE) END
           AS match_confidence,
         CASE WHEN dupe_count = 1 THEN 'AUTO_MERGE' ELSE 'STEWARD_REVIEW' END AS decision
  FROM sized
)"""


def exact_parts(spark: SparkSession, folder: str, config: MatchConfig = EXACT) -> DataFrame:
    return exact.match_exact(parts(spark, folder), config)


@query(f"WITH {EXACT_SQL} SELECT * FROM scored")
def match_exact_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return exact_parts(spark, folder)


@query(f"""WITH {EXACT_SQL}
SELECT *, 'PROPOSED' AS mdm_state, 'glue_job' AS submitted_by,
  'Medium confidence match; requires steward review' AS review_reason
FROM scored WHERE decision = 'STEWARD_REVIEW'""")
def steward_queue_records(spark: SparkSession, folder: str) -> DataFrame:
    return timeless(exact.review_records(exact_parts(spark, folder)))


@query(f"""WITH {EXACT_SQL}
SELECT * REPLACE ('REJECT' AS decision), 'REJECTED' AS mdm_state,
  'Low confidence match; insufficient data quality' AS reject_reason
FROM scored WHERE dupe_count > 1""")
def mdm_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """With the medium threshold above 0.88, shared keys are rejected."""
    return timeless(exact.rejected_records(exact_parts(spark, folder, STRICT)))


@query(f"""WITH {EXACT_SQL}
SELECT *, 'ACTIVE' AS mdm_state, 'raw_reference' AS source_system,
  'min(p_partkey) per match_key' AS survivorship_rule
FROM scored WHERE decision = 'AUTO_MERGE'""")
def golden_master_exact(spark: SparkSession, folder: str) -> DataFrame:
    return timeless(exact.exact_master(exact_parts(spark, folder), "p_partkey"))


@query(f"""WITH {EXACT_SQL}
SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE decision = 'AUTO_MERGE') AS auto_merge_rows,
  count(*) FILTER (WHERE decision = 'STEWARD_REVIEW') AS steward_review_rows,
  count(*) FILTER (WHERE decision = 'REJECT') AS reject_rows,
  round(avg(match_confidence), 6) AS avg_match_confidence,
  CAST(0.95 AS DOUBLE) AS high_conf_threshold, CAST(0.8 AS DOUBLE) AS med_conf_threshold
FROM scored""")
def mdm_audit_exact(spark: SparkSession, folder: str) -> DataFrame:
    row = exact.exact_audit(exact_parts(spark, folder), EXACT.thresholds)
    return row.withColumn("avg_match_confidence", F.round("avg_match_confidence", 6))


# ---------------------------------------------------------------- matching by pairs

PREPARED_SQL = r"""
prepared AS (
  SELECT *, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS name_norm,
         trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) AS block_norm
  FROM part
)"""
# All pairs of records, one by one, scored and decided.
ALL_PAIRS_SQL = f"""{PREPARED_SQL},
record_pairs AS (
  SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, a.block_norm AS block,
    CASE WHEN (length(a.name_norm), a.name_norm) <= (length(b.name_norm), b.name_norm)
         THEN a.name_norm ELSE b.name_norm END AS name_a,
    CASE WHEN (length(a.name_norm), a.name_norm) <= (length(b.name_norm), b.name_norm)
         THEN b.name_norm ELSE a.name_norm END AS name_b
  FROM prepared a JOIN prepared b ON a.block_norm = b.block_norm AND a.p_partkey < b.p_partkey
),
likened AS (
  SELECT *, round(CAST(1 AS DOUBLE) - CAST(levenshtein(name_a, name_b) AS DOUBLE)
      / CAST(greatest(length(name_a), length(name_b)) AS DOUBLE), 4) AS name_similarity,
    split_part(name_a, ' ', 1) AS token_a, split_part(name_b, ' ', 1) AS token_b
  FROM record_pairs
),
weighted AS (
  SELECT *, CASE WHEN token_a = token_b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    AS token_match,
    round(name_similarity * CAST(0.9 AS DOUBLE)
      + CASE WHEN token_a = token_b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        * CAST(0.1 AS DOUBLE), 4) AS match_confidence
  FROM likened
),
decided AS (
  SELECT *, CASE WHEN match_confidence >= CAST(0.95 AS DOUBLE) THEN 'AUTO_MERGE'
    WHEN match_confidence >= CAST(0.8 AS DOUBLE) THEN 'STEWARD_REVIEW' ELSE 'REJECT' END AS decision
  FROM weighted
),
first_ids AS (
  SELECT block_norm, name_norm, min(p_partkey) AS first_id FROM prepared GROUP BY ALL
),
name_pairs AS (
  SELECT d.block, d.name_a, d.name_b, fa.first_id AS first_id_a, fb.first_id AS first_id_b,
    d.name_similarity, d.token_a, d.token_b, d.token_match, d.match_confidence, d.decision,
    count(*) AS pair_count
  FROM decided d
  JOIN first_ids fa ON d.block = fa.block_norm AND d.name_a = fa.name_norm
  JOIN first_ids fb ON d.block = fb.block_norm AND d.name_b = fb.name_norm
  GROUP BY ALL
)"""
MATCH_COUNTS = ("total_pairs", "auto_merge_pairs", "steward_review_pairs", "reject_pairs",
                "total_pairs_compared", "pair_count")


def _plain_counts(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, as SQL gives them; the operators keep them exact beyond that."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in MATCH_COUNTS if c in df.columns})


def matched_parts(spark: SparkSession, folder: str) -> PairMatching:
    return PairMatching.over(parts(spark, folder), "p_partkey", "p_name", "p_brand")


@query(r"""SELECT p_partkey AS id, p_name AS raw,
  trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS clean FROM part
UNION ALL SELECT c_custkey, c_name,
  trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) FROM customer
UNION ALL SELECT page_id, url,
  trim(regexp_replace(upper(url), '[^A-Z0-9]+', ' ', 'g')) FROM pages""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    named = (
        table(spark, folder, "part").select(F.col("p_partkey").alias("id"),
                                            F.col("p_name").alias("raw"))
        .union(table(spark, folder, "customer").select("c_custkey", "c_name"))
        .union(table(spark, folder, "pages").select("page_id", "url"))
    )
    return named.withColumn("clean", normalized(F.col("raw")))


@query(f"WITH {ALL_PAIRS_SQL} SELECT * FROM name_pairs WHERE decision <> 'REJECT'")
def match_pairs_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Name pairs at or above the medium threshold, best first."""
    return mp.by_confidence(_plain_counts(matched_parts(spark, folder).scored))


@query(f"""WITH {ALL_PAIRS_SQL}
SELECT first_id_a, first_id_b, name_a, name_b, block, name_similarity, match_confidence, decision,
  pair_count, 'PENDING' AS review_status
FROM name_pairs WHERE decision = 'STEWARD_REVIEW'""")
def steward_queue_pairs(spark: SparkSession, folder: str) -> DataFrame:
    queue = mp.steward_pairs(matched_parts(spark, folder).scored)
    return mp.by_confidence(_plain_counts(timeless(queue)))


@query(f"""WITH {ALL_PAIRS_SQL}
SELECT b.block, b.records, count(d.decision) AS total_pairs,
  count(*) FILTER (WHERE decision = 'AUTO_MERGE') AS auto_merge_pairs,
  count(*) FILTER (WHERE decision = 'STEWARD_REVIEW') AS steward_review_pairs,
  count(*) FILTER (WHERE decision = 'REJECT') AS reject_pairs
FROM (SELECT block_norm AS block, count(*) AS records FROM prepared GROUP BY ALL) b
LEFT JOIN decided d ON b.block = d.block GROUP BY b.block, b.records""")
def reject_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Per block: size, all pairs, and how many of them are rejects."""
    return _plain_counts(matched_parts(spark, folder).blocks())


@query(f"""WITH {ALL_PAIRS_SQL}
SELECT (SELECT count(*) FROM prepared) AS total_rows, count(*) AS total_pairs_compared,
  count(*) FILTER (WHERE decision = 'AUTO_MERGE') AS auto_merge_pairs,
  count(*) FILTER (WHERE decision = 'STEWARD_REVIEW') AS steward_review_pairs,
  count(*) FILTER (WHERE decision = 'REJECT') AS reject_pairs,
  round(avg(match_confidence) FILTER (WHERE decision <> 'REJECT'), 6) AS avg_matched_confidence,
  CAST(0.95 AS DOUBLE) AS high_conf_threshold, CAST(0.8 AS DOUBLE) AS med_conf_threshold
FROM decided""")
def mdm_audit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    row = _plain_counts(matched_parts(spark, folder).audit())
    return row.withColumn("avg_matched_confidence", F.round("avg_matched_confidence", 6))


@query(f"""WITH {PREPARED_SQL}
SELECT block_norm AS block, name_norm AS name, p_partkey AS id,
  min(p_partkey) OVER w AS survivor_id, count(*) OVER w AS records
FROM prepared WINDOW w AS (PARTITION BY block_norm, name_norm)
QUALIFY count(*) OVER w > 1""")
def merge_links(spark: SparkSession, folder: str) -> DataFrame:
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    return mp.merge_links(mp.members(prepared, "p_partkey"))


# Names at 0.8 or more, and whatever hangs together by way of them.
CLUSTERS_SQL = f"""WITH RECURSIVE {ALL_PAIRS_SQL},
links AS (SELECT DISTINCT block, name_a, name_b FROM name_pairs
  WHERE decision <> 'REJECT' AND name_a <> name_b),
edges AS (SELECT * FROM links UNION SELECT block, name_b, name_a FROM links),
reach AS (SELECT DISTINCT block_norm AS block, name_norm AS name, name_norm AS other FROM prepared
  UNION SELECT r.block, r.name, e.name_b FROM reach r
  JOIN edges e ON r.block = e.block AND r.other = e.name_a),
facts AS (SELECT r.block, r.name, min(p_partkey) AS survivor_id, count(*) AS records
  FROM reach r JOIN prepared p ON r.block = p.block_norm AND r.other = p.name_norm GROUP BY ALL)"""


@query(f"""{CLUSTERS_SQL}
SELECT f.block, f.name, p_partkey AS id, survivor_id, records
FROM facts f JOIN prepared p ON f.block = p.block_norm AND f.name = p.name_norm""")
def merge_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each part with the part it merges into, by way of any chain of like names."""
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    return mp.merge_clusters(mp.members(prepared, "p_partkey"), fv.MEDIUM_CONFIDENCE)


SLICE = (300, 20_000)


@query(f"""WITH {ALL_PAIRS_SQL},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY block_norm ORDER BY p_partkey) - 1 AS position
  FROM prepared WHERE block_norm IS NOT NULL
),
by_rank AS (
  SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, a.name_norm AS own_a, b.name_norm AS own_b,
    row_number() OVER (ORDER BY a.block_norm, b.position, a.position) - 1 AS rank
  FROM ordered a JOIN ordered b ON a.block_norm = b.block_norm AND a.position < b.position
)
SELECT r.id_a, r.id_b, own_a AS name_a, own_b AS name_b, block, name_similarity, match_confidence,
  decision
FROM by_rank r JOIN decided d ON r.id_a = d.id_a AND r.id_b = d.id_b
WHERE decision = 'REJECT' AND rank >= {SLICE[0]} AND rank < {SLICE[0] + SLICE[1]}""")
def reject_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected pairs of records in one slice of the ranks of all pairs: rows for a steward to look at."""
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    records = staged(ranked_pairs.numbered(mp.members(prepared, "p_partkey")), "ranked-parts")
    blocks = ranked_pairs.blocks_of(records)
    return ranked_pairs.rejects(ranked_pairs.pair_slice(records, blocks, *SLICE))


@query(f"""WITH {ALL_PAIRS_SQL}
SELECT count(match_confidence) AS total_pairs, round(avg(match_confidence), 6) AS avg_confidence,
  round(avg(match_confidence), 6) AS low, round(avg(match_confidence), 6) AS high,
  CAST(0 AS BIGINT) AS sampled_blocks
FROM decided""")
def mean_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Average confidence over matched and rejected pairs; exact while blocks are small."""
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    found = _plain_counts(ranked_pairs.mean_confidence(mp.members(prepared, "p_partkey")))
    return found.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "low", "high")})


@query(f"""WITH {PREPARED_SQL}, ranked AS (
  SELECT p_partkey, p_name, p_brand, p_type, name_norm, block_norm,
    block_norm || '::' || name_norm AS match_key,
    row_number() OVER (PARTITION BY block_norm, name_norm ORDER BY p_partkey) AS rn FROM prepared)
SELECT * EXCLUDE (rn), 'ACTIVE' AS mdm_state, 'min(p_partkey) per match_key' AS survivorship_rule
FROM ranked WHERE rn = 1""")
def golden_master_all(spark: SparkSession, folder: str) -> DataFrame:
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    return timeless(golden.golden_master(prepared, ["match_key"], "p_partkey"))


@query(f"""WITH {PREPARED_SQL}
SELECT block_norm || '::' || name_norm AS match_key, count(*) AS count FROM prepared
GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    return golden.duplicates(prepared, "match_key")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return golden.duplicates(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- audit

@query(r"""SELECT l.*, CAST(l_partkey AS INTEGER) AS l_partkey_int, 'PART_NOT_IN_MASTER' AS orphan_type
FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT min(p_partkey) AS k FROM part
    GROUP BY trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')),
             trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g'))) g
  WHERE g.k = l.l_partkey)""")
def orphans_single_fk(spark: SparkSession, folder: str) -> DataFrame:
    prepared = mp.prepare(parts(spark, folder), "p_partkey", "p_name", "p_brand")
    master = golden.survivors(prepared, ["match_key"], "p_partkey")
    return audit.orphans(table(spark, folder, "lineitem"), master, "p_partkey",
                         {"l_partkey": "PART_NOT_IN_MASTER"})


@query("""SELECT event_id, 3000000000 + user_id AS wide_key, 'USER_NOT_IN_MASTER' AS orphan_type
FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""")
def orphans_wide_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys beyond 32 bits, on one side as text."""
    events = table(spark, folder, "events").select(
        "event_id", (F.col("user_id") + 3_000_000_000).alias("wide_key"))
    master = table(spark, folder, "customer").where("c_custkey % 3 <> 0").select(
        (F.col("c_custkey") + 3_000_000_000).cast("string").alias("key"))
    return audit.orphans(events, master, "key", {"wide_key": "USER_NOT_IN_MASTER"},
                         key_copies=False)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, orphan_type FROM (
  SELECT *, 'PART_NOT_IN_MASTER' AS orphan_type FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)
  UNION ALL
  SELECT *, 'SUPPLIER_NOT_IN_MASTER' FROM lineitem
  WHERE l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0))""")
def orphans_by_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """A key set above the broadcast limit, here of 0 bytes: bitmaps, and no shuffle of the fact."""
    master = table(spark, folder, "part").where("p_partkey % 3 <> 0")
    fact = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return audit.orphans(fact, master, "p_partkey", {
        "l_partkey": "PART_NOT_IN_MASTER", "l_suppkey": "SUPPLIER_NOT_IN_MASTER"},
        key_copies=False, limit=0)


MASTER_ZONES_SQL = """
master_zones AS (SELECT min(LocationID) AS LocationID FROM zones GROUP BY Borough)"""


@query(f"""WITH {TRIPS_SQL}, {ZONES_SQL}, {MASTER_ZONES_SQL},
found AS (
  SELECT *, 'PICKUP_NOT_IN_MASTER' AS orphan_type FROM trips
  WHERE PULocationID NOT IN (SELECT LocationID FROM master_zones)
  UNION ALL
  SELECT *, 'DROPOFF_NOT_IN_MASTER' FROM trips
  WHERE DOLocationID NOT IN (SELECT LocationID FROM master_zones))
SELECT *, PULocationID AS PULocationID_int, DOLocationID AS DOLocationID_int FROM found""")
def orphans_multi_fk(spark: SparkSession, folder: str) -> DataFrame:
    """Zones are merged to one per borough, so trips to the merged ones are orphans."""
    master = golden.survivors(zones(spark, folder), ["Borough"], fv.ZONE_KEY)
    return audit.orphans(trips(spark, folder), master)


@query(f"""WITH {EXACT_SQL}
SELECT CASE WHEN dupe_count = 1 THEN 'ACTIVE' ELSE 'PROPOSED' END AS mdm_state,
  dupe_count = 1 AS mdm_state_valid, count(*) AS record_count
FROM scored GROUP BY ALL""")
def lifecycle_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Records by state; PROPOSED is left out of the configured states here, so it is not valid."""
    scored = exact_parts(spark, folder)
    records = exact.exact_master(scored, "p_partkey").unionByName(
        exact.review_records(scored), allowMissingColumns=True)
    return audit.lifecycle_snapshot(records, [fv.STATE_ACTIVE, fv.STATE_REJECTED])


@query("SELECT 'ACTIVE' AS mdm_state, true AS mdm_state_valid, count(*) AS record_count FROM part")
def lifecycle_default_active(spark: SparkSession, folder: str) -> DataFrame:
    return audit.lifecycle_snapshot(parts(spark, folder), fv.REQUIRED_STATES)


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  CAST(NULL AS BIGINT) AS s_suppkey FROM customer
UNION ALL SELECT NULL, s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier""")
def union_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").withColumnsRenamed(
        {"s_name": "c_name", "s_nationkey": "c_nationkey", "s_acctbal": "c_acctbal"})
    return table(spark, folder, "customer").unionByName(suppliers, allowMissingColumns=True)


@query(f"""WITH {EXACT_SQL}
SELECT 'part_master' AS table_name, count(*) AS num_rows, NULL AS partition_by,
  true AS schema_is_its_own FROM scored WHERE decision = 'AUTO_MERGE'
UNION ALL SELECT 'part_master', count(*), NULL, true FROM scored
  WHERE decision = 'AUTO_MERGE' AND p_partkey % 2 = 0
UNION ALL SELECT 'orders', count(*), 'o_orderstatus', true FROM orders""")
def history_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Master written whole and then its even keys, orders once; what was noted of each write."""
    root = fresh_path(spark, "history")
    store = TableStore(spark, f"{root}/writes", format="parquet")
    master = exact.exact_master(exact_parts(spark, folder), "p_partkey")
    orders = table(spark, folder, "orders")
    store.write(master, f"{root}/master")
    store.write(master.where("p_partkey % 2 = 0"), f"{root}/master")
    store.write(orders, f"{root}/orders", partition_by="o_orderstatus")
    noted = store.history_audit(
        {"part_master": f"{root}/master", "orders": f"{root}/orders"}, "history-audit")
    own = F.when(F.col("table_name") == "orders", F.lit(orders.schema.json())).otherwise(
        F.lit(master.schema.json()))
    return noted.select("table_name", "num_rows", "partition_by",
                        (F.col("table_schema") == own).alias("schema_is_its_own"))


@query("SELECT * FROM orders")
def partitioned_table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "orders")
    orders = table(spark, folder, "orders")
    store = TableStore(spark, f"{root}/commits", format="parquet")
    store.write(orders, f"{root}/table", partition_by="o_orderstatus")
    return store.read(f"{root}/table")


@query("""SELECT o_orderkey, year(o_orderdate) AS order_year,
  CASE WHEN year(o_orderdate) IN (1994, 1996) THEN o_totalprice * 2 ELSE o_totalprice END AS total,
  CASE WHEN year(o_orderdate) IN (1994, 1996) THEN 'second' ELSE 'first' END AS written
FROM orders""")
def replaced_years(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by year, of which two years were written again and the others left as they were."""
    root = fresh_path(spark, "orders-by-year")
    store = TableStore(spark, f"{root}/writes", format="parquet")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("order_year"), F.col("o_totalprice").alias("total"),
        F.lit("first").alias("written"))
    store.write(orders, f"{root}/table", partition_by="order_year")
    again = orders.where(F.col("order_year").isin(1994, 1996)).withColumns(
        {"total": F.col("total") * 2, "written": F.lit("second")})
    store.write(again, f"{root}/table", partition_by="order_year", only_given=True)
    return store.read(f"{root}/table")


@query("""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 5 = 0 THEN 'l_quantity' WHEN l_linenumber = 2 THEN 'l_tax' END AS columns,
  CASE WHEN l_orderkey % 5 = 0 THEN 'not a value of type double'
       WHEN l_linenumber = 2 THEN 'not a value of type double' END AS reasons,
  CAST(l_orderkey AS VARCHAR) || ',' || l_linenumber || ','
    || CASE WHEN l_orderkey % 5 = 0 THEN 'many' ELSE '3.5' END || ','
    || CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'n/a' END AS line
FROM lineitem WHERE l_orderkey % 5 = 0 OR l_linenumber = 2
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL FROM lineitem
WHERE l_orderkey % 5 <> 0 AND l_linenumber <> 2""")
def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with malformed numbers kept apart with their text; a missing tax is no fault."""
    path = fresh_path(spark, "lines-csv")
    odd = F.col("l_orderkey") % 5 == 0
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(odd, "many").otherwise("3.5").alias("l_quantity"),
        F.when(odd, F.lit(None)).when(F.col("l_linenumber") == 2, "n/a").otherwise("0.25").alias("l_tax"))
    write_csv(lines, path)
    good, bad = read_csv_checked(spark, path, T.StructType([
        T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()), T.StructField("l_tax", T.DoubleType())]))
    keys = F.split("line", ",")
    return bad.select(
        keys[0].cast("bigint").alias("l_orderkey"), keys[1].cast("int").alias("l_linenumber"),
        F.array_join("problems.column", ",").alias("columns"),
        F.array_join("problems.reason", ",").alias("reasons"), "line",
    ).unionByName(good.select("l_orderkey", "l_linenumber"), allowMissingColumns=True)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
  ELSE ' ' || replace(text, 'e', '"') || chr(10) END AS text, lang, source, n_chars
FROM documents""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line feeds, quotes, outer blanks, empty and missing ones."""
    path = fresh_path(spark, "documents-csv")
    documents = table(spark, folder, "documents")
    text = F.concat(F.lit(" "), F.replace("text", F.lit("e"), F.lit('"')), F.lit("\n"))
    documents = documents.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(None))
                                     .when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(text))
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema, multi_line=True)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ''
  ELSE replace(replace(text, 'a', '"'), ' ', CASE doc_id % 3 WHEN 0 THEN chr(10)
    WHEN 1 THEN chr(13) || chr(10) ELSE ' ,' END) END AS text, source, n_chars
FROM documents""")
def csv_records_in_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Records of many lines each, out of files that several tasks read."""
    path = fresh_path(spark, "records-csv")
    part = F.col("doc_id") % 3
    blank = F.when(part == 0, "\n").when(part == 1, "\r\n").otherwise(" ,")
    text = F.replace(F.replace("text", F.lit("a"), F.lit('"')), F.lit(" "), blank)
    documents = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 0, F.lit(""))
        .otherwise(text).alias("text"), "source", "n_chars")
    write_csv(documents, path)
    return read_csv_records(spark, path, documents.schema)


@query("""SELECT o_orderkey, o_orderdate, o_totalprice,
  CASE WHEN year(o_orderdate) % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def folders_as_one(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of part files that were written apart are one table; one of them has a column more."""
    root = fresh_path(spark, "orders-by-folder")
    orders = table(spark, folder, "orders")
    columns = ["o_orderkey", "o_orderdate", "o_totalprice"]
    for i in (2, 1, 0):
        part = orders.where(F.year("o_orderdate") % 3 == i)
        part.select(*columns, *(["o_orderstatus"] if i == 2 else [])).write.parquet(f"{root}/year{i}")
    return read_parquet(spark, *[f"{root}/year{i}" for i in (2, 1, 0)])


@query("""SELECT 'parquet' AS format, (SELECT count(*) FROM orders) AS rows_written, o_orderstatus,
  count(*) AS row_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_orderstatus""")
def store_without_delta(spark: SparkSession, folder: str) -> DataFrame:
    """A store that is named no format takes Parquet where Delta is not installed, and says so."""
    store = TableStore(spark, fresh_path(spark, "fallback-audit"))
    path = fresh_path(spark, "fallback-orders")
    written = store.write(table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")),
        path, partition_by="o_orderstatus")
    return store.read(path).groupBy("o_orderstatus").agg(
        F.count("*").alias("row_count"), F.sum("o_totalprice").cast("double").alias("total")).select(
            F.lit(written.format).alias("format"), F.lit(written.rows).cast("bigint").alias("rows_written"),
            "o_orderstatus", "row_count", "total")


@query("""SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 5000000000 END AS p_partkey,
  CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_partkey % 2 <> 0 THEN p_brand END AS p_brand FROM part""")
def catalog_crawl_widened(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose numbers grew from int to bigint and double are one table in the wider types."""
    database, root = _sample_database(spark), fresh_path(spark, "grown-lake")
    parts = table(spark, folder, "part")
    even, odd = parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 2 <> 0")
    even.selectExpr("CAST(p_partkey AS INT) AS p_partkey", "CAST(p_size AS INT) AS p_size").write.parquet(
        f"{root}/grown")
    odd.selectExpr("CAST(p_partkey AS BIGINT) + 5000000000 AS p_partkey", "CAST(p_size AS DOUBLE) AS p_size",
                   "p_brand").write.mode("append").parquet(f"{root}/grown")
    spark.sql(f"DROP TABLE IF EXISTS {database}.grown")
    catalog.crawl(spark, database, root)
    return spark.table(f"{database}.grown")


@query("""SELECT p_partkey, p_size, p_retailprice, p_brand FROM part""")
def csv_inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types as guessed from the text: whole numbers, fractions and words."""
    path = fresh_path(spark, "parts-inferred-csv")
    write_csv(table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice", "p_brand"), path)
    return read_csv_inferred(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("""SELECT 'events' AS table_name, true AS readable, count(*) AS row_count FROM events
UNION ALL SELECT 'no_such_table', false, 0""")
def optional_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A table that is there, and one that a job has to do without."""
    found = None
    for name in ("events", "no_such_table"):
        df, _ = read_optional(lambda name=name: table(spark, folder, name))
        rows = spark.range(0) if df is None else df
        one = rows.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(df is not None).alias("readable"), "row_count")
        found = one if found is None else found.unionByName(one)
    return found


# ---------------------------------------------------------------- whole run

SAMPLE_RULES = tuple(r for r in RULES if r.name != "total_over_code")
# The whole key: borough and name of a zone.
ZONE_MATCH_KEY = "concat_ws('::', upper(Borough), upper(Zone))"
SAMPLE_ARTIFACTS = Artifacts(
    contract=CONTRACT,
    quality=QualityConfig(SAMPLE_RULES, QualityPolicy(min_pass_rate=0.5)),
    match=MatchConfig(ZONE_MATCH_KEY),
    lifecycle=Lifecycle(frozenset(fv.REQUIRED_STATES)),
)

VALID_SQL = f"""WITH {TRIPS_SQL}, {ZONES_SQL},
valid AS (SELECT * FROM trips WHERE dropoff_datetime >= pickup_datetime AND fare_amount >= 0
  AND total_amount >= 0 AND trip_distance >= 0 AND passenger_count >= 0),
passed AS (SELECT * FROM valid WHERE RatecodeID BETWEEN 1 AND 6)"""
# Nations whose key is even are there twice, under another key: they go to the stewards.
DOUBLED_SQL = """,
doubled AS (SELECT LocationID, Borough, Zone FROM zones
  UNION ALL SELECT LocationID + 1000, Borough, Zone FROM zones WHERE LocationID % 2 = 0),
master AS (SELECT min(LocationID) AS k FROM doubled
  GROUP BY upper(Borough), upper(Zone) HAVING count(*) = 1)"""
COUNTS_SQL = """
SELECT 'valid' AS stage, count(*) AS row_count FROM valid
UNION ALL SELECT 'passed', count(*) FROM passed
UNION ALL SELECT 'rejects', (SELECT count(*) FROM valid) - (SELECT count(*) FROM passed)
UNION ALL SELECT 'master', count(*) FROM master
UNION ALL SELECT 'orphans',
  count(*) FILTER (WHERE PULocationID NOT IN (SELECT k FROM master))
  + count(*) FILTER (WHERE DOLocationID NOT IN (SELECT k FROM master)) FROM passed"""


def doubled_zones(spark: SparkSession, folder: str) -> DataFrame:
    given = zones(spark, folder)
    again = given.where("LocationID % 2 = 0").withColumn("LocationID", F.col("LocationID") + 1000)
    return given.unionByName(again)


def sample_run(spark: SparkSession, folder: str, root: str, artifacts: Artifacts) -> GovernedRun:
    write_parquet(trips(spark, folder), f"{root}/in/trips")
    write_csv(doubled_zones(spark, folder), f"{root}/in/zones")
    places = Places.under(f"{root}/out", f"{root}/in/trips", f"{root}/in/zones")
    # Thousands of dates with a handful of rows each would only measure file creation.
    return GovernedRun(spark, places, artifacts, "governed-run", partition_by="RatecodeID",
                       table_format="parquet")


def _written_counts(run: GovernedRun) -> DataFrame:
    places, spark = run.places, run.spark
    tables = {"valid": places.validated, "passed": places.passed, "master": places.master}
    counts = run.store.history_audit(tables, run.job_name).select(
        F.col("table_name").alias("stage"), F.col("num_rows").alias("row_count"))
    rejects = read_parquet(spark, places.rejects).agg(F.count("*")).select(F.lit("rejects"), "*")
    orphans = read_parquet(spark, places.summary).select(F.lit("orphans"), "orphans_count")
    return counts.union(rejects).union(orphans)


@query(VALID_SQL + DOUBLED_SQL + COUNTS_SQL)
def governed_run(spark: SparkSession, folder: str) -> DataFrame:
    """All five stages over trips and zones; row counts of what was written."""
    run = sample_run(spark, folder, fresh_path(spark, "governed-run"), SAMPLE_ARTIFACTS)
    run.run()
    return _written_counts(run)


def _as_document(text: str, spark: SparkSession, path: str) -> str:
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    return path


@query(VALID_SQL + DOUBLED_SQL + COUNTS_SQL)
def governed_run_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same run, governed by four documents that are read and checked first."""
    root = fresh_path(spark, "governed-files")
    documents = {
        "metadata": {"source": "SAMPLE", "dataset_name": "trips", "classification": "internal",
                     "schema": [{"name": n, "type": t} for n, t in CONTRACT.types.items()]},
        "quality": {"rules": [{"id": r.name, "expression_sql": r.sql} for r in SAMPLE_RULES],
                    "policy": {"default_min_pass_rate": 0.5}},
        "match": {"blocking_keys": [{"expression": ZONE_MATCH_KEY}]},
        "lifecycle": {"states": [{"name": n} for n in fv.REQUIRED_STATES]},
    }
    paths = {name: _as_document(json.dumps(document), spark, f"{root}/artifacts/{name}")
             for name, document in documents.items()}
    run = sample_run(spark, folder, root, Artifacts.load(spark, paths))
    run.run()
    return _written_counts(run)


@query(VALID_SQL + """
SELECT 'validated' AS stage, count(*) AS row_count FROM valid
UNION ALL SELECT 'curated', count(*) FROM valid""")
def governed_stages_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Two stages run one at a time, by name."""
    run = sample_run(spark, folder, fresh_path(spark, "governed-modes"), SAMPLE_ARTIFACTS)
    run.run("conform")
    run.run(" ENRICH ")
    tables = {"validated": run.places.validated, "curated": run.places.curated}
    return run.store.history_audit(tables, run.job_name).select(
        F.col("table_name").alias("stage"), F.col("num_rows").alias("row_count"))


@query(VALID_SQL + """
SELECT 'refused' AS outcome, (SELECT count(*) FROM passed) AS passed_rows,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM passed) AS rejected_rows""")
def governed_gate_fails(spark: SparkSession, folder: str) -> DataFrame:
    """A pass rate under the policy stops the run; what was written for it stays."""
    strict = replace(SAMPLE_ARTIFACTS, quality=QualityConfig(
        SAMPLE_RULES, QualityPolicy(min_pass_rate=1.0)))
    run = sample_run(spark, folder, fresh_path(spark, "governed-gate"), strict)
    outcome = "passed"
    try:
        for stage in ("conform", "enrich", "quality"):
            run.run(stage)
    except quality.QualityBelowThreshold:
        outcome = "refused"
    good = run.store.read(run.places.passed).agg(F.count("*").alias("passed_rows"))
    bad = read_parquet(spark, run.places.rejects).agg(F.count("*").alias("n"))
    return good.unionByName(bad.select(F.lit(None).cast("bigint").alias("passed_rows"), "n"),
                            allowMissingColumns=True).agg(
        F.max("passed_rows").alias("passed_rows"), F.max("n").alias("rejected_rows")).select(
        F.lit(outcome).alias("outcome"), "passed_rows", "rejected_rows")


PINNED = dt.datetime(2026, 1, 6, 12, 30, 45, 250_000, tzinfo=dt.timezone.utc)


@query(f"""WITH {TRIPS_SQL}, {ZONES_SQL}, {MASTER_ZONES_SQL}
SELECT 'summary' AS job_name, count(*) FILTER (WHERE PULocationID NOT IN
    (SELECT LocationID FROM master_zones))
  + count(*) FILTER (WHERE DOLocationID NOT IN (SELECT LocationID FROM master_zones))
    AS orphans_count, 'h' AS audit_history_out_path, 'c' AS curated_trips_path,
  'l' AS lifecycle_snapshot_path, 'm' AS master_zones_path, 'o' AS orphans_out_path,
  TIMESTAMP '2026-01-06 12:30:45.25' AS generated_at_utc FROM trips""")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row on an audit run, at a pinned moment."""
    master = golden.survivors(zones(spark, folder), ["Borough"], fv.ZONE_KEY)
    lost = audit.orphans(trips(spark, folder), master).count()
    row = audit.run_summary(spark, {
        "audit_history_out_path": "h", "curated_trips_path": "c", "job_name": "summary",
        "lifecycle_snapshot_path": "l", "master_zones_path": "m", "orphans_count": lost,
        "orphans_out_path": "o"}, PINNED)
    return row.withColumn("generated_at_utc", F.col("generated_at_utc").cast("timestamp_ntz"))


@query(f"""WITH {TRIPS_SQL}
SELECT l_orderkey, l_linenumber, pickup_datetime AS pickup_ts, dropoff_datetime AS dropoff_ts,
  total_amount AS airport_fee, TIMESTAMP '2026-01-06 12:30:45.25' AS ingested_at FROM trips
WHERE dropoff_datetime >= pickup_datetime AND fare_amount >= 0 AND total_amount >= 0
  AND trip_distance >= 0 AND passenger_count >= 0""")
def conform_times_and_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Event times and the moment of the run, which is pinned; a misspelt column is renamed."""
    (found, wanted), = fv.RENAMES.items()
    raw = trips(spark, folder).withColumn(found, F.col("total_amount"))
    done = conform.conform(raw, CONTRACT, moment=PINNED)
    zoned = (fv.START_TS, fv.END_TS, "ingested_at")
    return done.select("l_orderkey", "l_linenumber", wanted,
                       *[F.col(c).cast("timestamp_ntz").alias(c) for c in zoned])


@query(" UNION ALL ".join((
    f"SELECT 'master' AS output, count(*) AS row_count FROM ({QUERIES['golden_master_all'].sql})",
    f"SELECT 'matched_names', count(*) FROM ({QUERIES['match_pairs_scored'].sql})",
    f"SELECT 'steward_queue', count(*) FROM ({QUERIES['steward_queue_pairs'].sql})",
    f"SELECT 'duplicate_keys', count(*) FROM ({QUERIES['duplicate_keys'].sql})",
)))
def pair_matching_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-alone matching run; its outputs are read back from where it wrote them."""
    root = fresh_path(spark, "pair-matching")
    store = TableStore(spark, f"{root}/writes", format="parquet")
    places = matched_parts(spark, folder).write(store, f"{root}/out", "pair-matching", PINNED)
    counts = None
    for name in ("master", "matched_names", "steward_queue", "duplicate_keys"):
        read = read_csv_inferred if name == "duplicate_keys" else read_parquet
        one = read(spark, places[name]).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("output"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("WITH " + ALL_PAIRS_SQL.replace(
    "trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) AS block_norm",
    f"'{fv.MISSING_AREA}' AS block_norm")
    + " SELECT * FROM name_pairs WHERE decision <> 'REJECT'")
def match_without_block(spark: SparkSession, folder: str) -> DataFrame:
    """A table without a block column is one block, in which all names are matched."""
    return mp.by_confidence(_plain_counts(
        PairMatching.over(parts(spark, folder), "p_partkey", "p_name", None).scored))


# ---------------------------------------------------------------- catalog

DTYPES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int",
                 "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
               "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{d}' AS data_type, "
    f"count(*) AS row_count, count(*) - count({c}) AS null_count FROM {t}"
    for t, columns in DTYPES.items() for c, d in columns.items()))
def dataset_profile(spark: SparkSession, folder: str) -> DataFrame:
    profiles = [
        catalog.profile_files(spark, f"{folder}/{t}.parquet").select(
            F.lit(t).alias("table_name"), "*")
        for t in TABLES
    ]
    whole = profiles[0]
    for more in profiles[1:]:
        whole = whole.unionByName(more)
    return whole


REGISTERED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS name, 'parquet' AS format, true AS at_source, "
    f"(SELECT count(*) FROM {t}) AS row_count" for t in TABLES)


def _registered(spark: SparkSession, database: str, places: dict[str, str]) -> DataFrame:
    """What the catalog says of tables, and their rows as read through it."""
    counts = None
    for name in places:
        one = spark.table(f"{database}.{name}").agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    known = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    location = F.regexp_replace("location", "^file:/*", "/")
    details = catalog.table_details(spark, database, list(places)).withColumn(
        "at_source", location == F.regexp_replace(known[F.col("name")], "^file:/*", "/"))
    return details.drop("location").join(counts, "name")


def _sample_database(spark: SparkSession) -> str:
    database = "lakewarden_samples"
    catalog.create_database(spark, database, "sample tables", {"domain": "samples"},
                            location=f"{shared_folder(spark)}/{database}.db")
    catalog.update_database(spark, database, {"classification": "internal"})
    return database


@query(f"SELECT *, true AS governed FROM ({REGISTERED_SQL})")
def catalog_register(spark: SparkSession, folder: str) -> DataFrame:
    """Register the tables' files; list them with format, place and rows, and the properties."""
    database = _sample_database(spark)
    places = {t: f"{folder}/{t}.parquet" for t in TABLES}
    catalog.register_tables(spark, database, [catalog.Dataset(t, p) for t, p in places.items()])
    facts = {r["info_name"]: r["info_value"]
             for r in catalog.describe_database(spark, database).collect()}
    governed = all(x in facts["Properties"] for x in ("domain", "samples", "internal"))
    return _registered(spark, database, places).withColumn("governed", F.lit(governed))


@query(REGISTERED_SQL)
def catalog_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """Register whatever lies under the folder."""
    database = _sample_database(spark)
    done = catalog.crawl(spark, database, folder)
    return _registered(spark, database, {
        r.table: r.path for r in done if r.outcome != "missing" and r.table in TABLES})


@query("""SELECT 'first' AS crawl, 'whole' AS name, 'created' AS outcome, count(*) AS row_count,
  count(*) FILTER (WHERE o_orderkey % 2 = 0) AS with_priority FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'second', 'whole', 'updated', count(*), count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders
UNION ALL SELECT 'second', 'still', 'unchanged', count(*), count(*) FROM orders""")
def catalog_crawl_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Files with unlike columns are one table; a second crawl looks at the changed folder only."""
    database = _sample_database(spark)
    root, state = fresh_path(spark, "lake"), fresh_path(spark, "crawled")
    given = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    some = given.where("o_orderkey % 3 <> 0")

    def add(df: DataFrame) -> None:
        df.where("o_orderkey % 2 = 0").write.mode("append").parquet(f"{root}/whole")
        df.where("o_orderkey % 2 <> 0").select("o_orderkey").write.mode("append").parquet(f"{root}/whole")

    def crawled(name: str, tables: tuple[str, ...]) -> list[DataFrame]:
        outcomes = {r.table: r.outcome for r in catalog.crawl(spark, database, root, state)}
        return [staged(spark.table(f"{database}.{t}").agg(
            F.count("*").alias("row_count"), F.count("o_orderpriority").alias("with_priority")).select(
                F.lit(name).alias("crawl"), F.lit(t).alias("name"), F.lit(outcomes[t]).alias("outcome"),
                "row_count", "with_priority"), "crawl-counts") for t in tables]

    add(some)
    given.write.parquet(f"{root}/still")
    for t in ("whole", "still"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{t}")
    found = crawled("first", ("whole",))
    # New files, and a column the earlier crawl did not see.
    rest = given.where("o_orderkey % 3 = 0").withColumn("late", F.lit(1))
    add(rest.where("o_orderkey % 2 <> 0"))
    rest.where("o_orderkey % 2 = 0").write.mode("append").parquet(f"{root}/whole")
    found += crawled("second", ("whole", "still"))
    return reduce(DataFrame.unionByName, found)


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def preview_top_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The head of a sorted table, as a report shows it."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return catalog.preview(orders, 20, F.desc("o_totalprice"), "o_orderkey")


@query("""SELECT event_type, user_id, count(*) AS events FROM events GROUP BY ALL
HAVING count(*) > 1""")
def duplicate_event_keys(spark: SparkSession, folder: str) -> DataFrame:
    found = golden.duplicates(table(spark, folder, "events"), "event_type", "user_id")
    return found.withColumnRenamed("count", "events")


CSV_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.IntegerType()),
    T.StructField("p_brand", T.IntegerType()),
    T.StructField("p_name", T.StringType()),
])


@query("""SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CAST(NULL AS INTEGER) AS p_brand, p_name
FROM part""")
def csv_malformed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Text where the schema wants a number reads as NULL; columns go by name, not position."""
    path = fresh_path(spark, "parts-csv")
    write_csv(table(spark, folder, "part").select("p_name", "p_brand", "p_partkey"), path)
    return read_csv(spark, path, CSV_SCHEMA)
