"""Every registered query against its SQL, and the shape of the plans."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from lakewarden.plans.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WRITERS = {"dq_report_of_outputs", "history_audit", "partitioned_table_round_trip",
           "csv_round_trip", "csv_malformed_values", "csv_inferred_types", "governed_run",
           "governed_run_from_files", "governed_stages_by_mode", "governed_gate_fails",
           "catalog_register", "catalog_crawl", "match_pairs_scored", "steward_queue_pairs",
           "reject_pairs", "mdm_audit_pairs", "pair_matching_outputs", "run_summary", "merge_clusters",
           "match_without_block", "catalog_crawl_changes", "reject_evidence", "mean_confidence",
           "replaced_years", "csv_quarantine", "csv_records_in_splits",
           "folders_as_one", "store_without_delta", "catalog_crawl_widened"}

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    outcome, rows, _ = check_oracle.compare(spark, SMALL, name)
    assert outcome == "ok" and rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_query_crosses_rows(spark, plan_text, name):
    plan = plan_text(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_is_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert {n for n, q in QUERIES.items() if q.sql} <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1 and "pass_rate" in df.columns


def test_report_reads_only_the_columns_it_needs(spark, plan_text):
    plan = plan_text(contract.queries()["dq_report"](spark, SMALL))
    scans = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    lineitem = next(s for s in scans if "l_orderkey" in s)
    assert "l_extendedprice" not in lineitem and "l_comment" not in lineitem
    assert "Window" not in plan
