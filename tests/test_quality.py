import pytest
from pyspark.sql import functions as F

from lakewarden.config import QualityPolicy, Rule
from lakewarden.operators.quality import (
    QualityBelowThreshold,
    add_flags,
    derive_rules,
    enforce,
    fail_counts_long,
    passed,
    quarantined,
    report,
    report_of_outputs,
)

RULES = [Rule("positive", "x > 0"), Rule("named", "name IS NOT NULL")]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(
        [(1, "a"), (-1, "b"), (None, "c"), (2, None), (-3, None)], "x int, name string")


def test_rule_without_answer_fails(data, rows):
    got = add_flags(data, RULES)
    assert rows(got.select("x", "name", "dq_pass", F.array_join("failed_rules", ","))) == sorted([
        (1, "a", True, ""), (-1, "b", False, "positive"), (None, "c", False, "positive"),
        (2, None, False, "named"), (-3, None, False, "positive,named")], key=repr)


def test_rule_without_answer_may_pass(data):
    assert passed(add_flags(data, RULES, null_as_pass=True)).count() == 2


def test_each_row_goes_one_way(data):
    flagged = add_flags(data, RULES)
    good, bad = passed(flagged), quarantined(flagged)
    assert good.count() + bad.count() == data.count()
    assert "dq_pass" not in good.columns and "dq_pass" in bad.columns
    assert good.filter("size(failed_rules) > 0").count() == 0


def test_reports_agree(data):
    flagged = add_flags(data, RULES)
    direct = report(flagged, RULES, {"job_name": "j"}).first().asDict()
    assert direct == {"total_rows": 5, "passed_rows": 1, "failed_rows": 4, "pass_rate": 0.2,
                      "positive_fail_count": 3, "named_fail_count": 2, "job_name": "j"}
    again = report_of_outputs(passed(flagged), quarantined(flagged), RULES, {"job_name": "j"})
    assert again.first().asDict() == direct
    long = {r["rule_id"]: (r["checked_rows"], r["fail_count"])
            for r in fail_counts_long(flagged, RULES).collect()}
    assert long == {"positive": (5, 3), "named": (5, 2)}


def test_empty_input(data):
    row = report(add_flags(data.filter("x > 99"), RULES), RULES).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0.0)
    with pytest.raises(QualityBelowThreshold):
        enforce(row["pass_rate"], QualityPolicy())


def test_threshold_is_strict():
    enforce(0.95, QualityPolicy(0.95))
    enforce(0.1, QualityPolicy(0.95, fail_below=False))
    with pytest.raises(QualityBelowThreshold, match="0.9499"):
        enforce(0.9499, QualityPolicy(0.95))


def test_rule_names_may_not_hide_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="already columns"):
        add_flags(df, [Rule("X", "x > 0")])
    row = add_flags(df, [Rule("big", "x > 5"), Rule("big_or_odd", "big OR x % 2 = 1")]).first()
    assert (row["big"], row["big_or_odd"]) == (False, True)


def test_no_rules_pass_everything(data):
    assert passed(add_flags(data, [])).count() == 5


def test_derived_ranges(spark):
    df = spark.createDataFrame(
        [(-1, 0), (0, 1), (8, 6), (9, 7), (None, None)], "passenger_count int, RatecodeID int")
    rules = derive_rules(df)
    assert [r.name for r in rules] == ["passenger_count_range", "ratecode_range"]
    got = add_flags(df, rules, list_failed=False).collect()
    assert [r["passenger_count_range"] for r in got] == [False, True, True, False, True]
    assert [r["ratecode_range"] for r in got] == [False, True, True, False, True]


def test_derived_rules_follow_the_columns(spark):
    df = spark.sql("SELECT 1 AS VendorID, 'x' AS fare_amount, CAST(NULL AS DOUBLE) AS extra,"
                   " timestamp'2024-01-01' AS lpep_pickup_datetime,"
                   " timestamp'2024-01-02' AS pickup_datetime,"
                   " timestamp'2024-01-01 12:00:00' AS dropoff_datetime, 3 AS PULocationID")
    rules = derive_rules(df)
    assert [r.name for r in rules] == [
        "vendor_not_null", "pu_location_not_null", "pickup_not_null", "dropoff_not_null",
        "pickup_before_dropoff", "fare_amount_non_negative", "extra_non_negative"]
    row = add_flags(df, rules, list_failed=False).first()
    # `pickup_datetime` goes before the lpep name here, text is no fare, NULL is fine.
    assert (row["pickup_before_dropoff"], row["fare_amount_non_negative"],
            row["extra_non_negative"]) == (False, False, True)


def test_report_is_one_aggregation_without_joins(data):
    plan = report(add_flags(data, RULES), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1,), (-1,)], "`x.y` int")
    rules = [Rule("r.1", "`x.y` > 0")]
    flagged = add_flags(df, rules)
    assert [r["failed_rules"] for r in flagged.collect()] == [[], ["r.1"]]
    assert report(flagged, rules).first()["r.1_fail_count"] == 1
    assert report_of_outputs(passed(flagged), quarantined(flagged), rules).first()["passed_rows"] == 1
    assert fail_counts_long(flagged, rules).first()["fail_count"] == 1
