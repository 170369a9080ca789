"""Names, labels and numbers that results must carry exactly as written here."""

# Column names a trip table may use for its start and end, in order of preference.
CONFORM_START_COLUMNS = ("tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime")
CONFORM_END_COLUMNS = ("tpep_dropoff_datetime", "lpep_dropoff_datetime", "dropoff_datetime")
QUALITY_START_COLUMNS = ("tpep_pickup_datetime", "pickup_datetime", "lpep_pickup_datetime")
QUALITY_END_COLUMNS = ("tpep_dropoff_datetime", "dropoff_datetime", "lpep_dropoff_datetime")

# Names of the standard event columns.
START_TS = "pickup_ts"
END_TS = "dropoff_ts"
START_DATE = "pickup_date"
DURATION_MIN = "trip_duration_min"

# Measures that may not be negative.
CONFORM_NON_NEGATIVE = ("fare_amount", "total_amount", "trip_distance", "passenger_count")
QUALITY_NON_NEGATIVE = (
    "trip_distance", "fare_amount", "total_amount", "tip_amount", "tolls_amount", "extra",
)
# The stand-alone conform variant asks for a fare above zero.
CONFORM_POSITIVE = ("fare_amount",)

# Spelling fixed on the way in: found name -> wanted name.
RENAMES = {"Airport_fee": "airport_fee"}

# Contract type names.
CONTRACT_TYPES = ("timestamp", "double", "int", "string")

# Stamps used when a contract does not name its own.
DEFAULT_SOURCE = "NYC_TLC"
DEFAULT_DATASET = "unknown_dataset"
DEFAULT_CLASSIFICATION = "unknown"
ZONE_VALIDATED = "validated"
ZONE_CURATED = "curated"

# Zone dimension.
ZONE_KEY = "LocationID"
ZONE_NAME = "Zone"
ZONE_NAME_ALTERNATIVE = "zone_name"
ZONE_AREA = "Borough"
ZONE_SERVICE = "service_zone"
START_FK = "PULocationID"
END_FK = "DOLocationID"
START_ROLE = "pu"
END_ROLE = "do"
MISSING_AREA = "UNKNOWN"

# Quality policy.
DEFAULT_MIN_PASS_RATE = 0.95
PASSENGER_RANGE = (0, 8)
RATE_CODE_RANGE = (1, 6)

# Matching.
HIGH_CONFIDENCE = 0.95
MEDIUM_CONFIDENCE = 0.80
AUTO_MERGE = "AUTO_MERGE"
STEWARD_REVIEW = "STEWARD_REVIEW"
REJECT = "REJECT"
UNIQUE_KEY_CONFIDENCE = 0.99
SHARED_KEY_CONFIDENCE = 0.88
NAME_WEIGHT = 0.90
TOKEN_WEIGHT = 0.10
SCORE_DIGITS = 4
KEY_SEPARATOR = "::"

# Lifecycle.
STATE_ACTIVE = "ACTIVE"
STATE_PROPOSED = "PROPOSED"
STATE_REJECTED = "REJECTED"
REQUIRED_STATES = (STATE_ACTIVE, STATE_PROPOSED, STATE_REJECTED)
REVIEW_PENDING = "PENDING"

# Texts stamped on master-data outputs.
MASTER_SOURCE = "raw_reference"
SUBMITTED_BY = "glue_job"
REVIEW_REASON = "Medium confidence match; requires steward review"
REJECT_REASON = "Low confidence match; insufficient data quality"

# Orphan labels.
START_ORPHAN = "PICKUP_NOT_IN_MASTER"
END_ORPHAN = "DROPOFF_NOT_IN_MASTER"

# Names of audited tables.
MASTER_TABLE = "master_zones"
FACT_TABLE = "curated_trips"

# Run modes accepted besides the stage names.
RUN_MODE_ALIASES = {
    "day6": "conform",
    "day7": "enrich",
    "day8": "quality",
    "day9": "match",
    "day10": "audit",
}

# Names of the rules that are derived from the columns of a table.
NOT_NULL_RULES = {
    "VendorID": "vendor_not_null",
    START_FK: "pu_location_not_null",
    END_FK: "do_location_not_null",
}
START_RULE = "pickup_not_null"
END_RULE = "dropoff_not_null"
ORDER_RULE = "pickup_before_dropoff"
NON_NEGATIVE_RULE = "_non_negative"
RANGE_RULES = {
    "passenger_count": ("passenger_count_range", *PASSENGER_RANGE),
    "RatecodeID": ("ratecode_range", *RATE_CODE_RANGE),
}

# Columns of the run summary; the count is a number, the others are text.
SUMMARY_COLUMNS = ("audit_history_out_path", "curated_trips_path", "job_name",
                   "lifecycle_snapshot_path", "master_zones_path", "orphans_count",
                   "orphans_out_path")
SUMMARY_COUNT = "orphans_count"
