import json

import pytest

from lakewarden.config import (
    ConfigError,
    Contract,
    Lifecycle,
    MatchConfig,
    QualityConfig,
    Thresholds,
    load_document,
)

RULE = {"id": "r", "expression_sql": "x > 0"}


def test_contract_ignores_what_it_does_not_know():
    contract = Contract.parse({"source": "S", "schema": [
        {"name": "a", "type": "int"}, {"name": "b", "type": "decimal"}, {"type": "int"}, "text"]})
    assert dict(contract.types) == {"a": "int"}
    assert (contract.source, contract.dataset_name) == ("S", "unknown_dataset")
    assert Contract.parse({}).source == "NYC_TLC"


@pytest.mark.parametrize("document", [
    {}, {"rules": []}, {"rules": [{"id": "r"}]}, {"rules": [{"expression_sql": "1=1"}]},
    {"rules": [RULE, RULE]}, {"rules": ["text"]},
    {"rules": [RULE], "policy": {"default_min_pass_rate": "much"}},
    {"rules": [RULE], "policy": {"default_min_pass_rate": 2}},
    {"rules": [RULE], "policy": {"fail_job_if_below_threshold": "maybe"}},
])
def test_bad_quality_documents(document):
    with pytest.raises(ConfigError):
        QualityConfig.parse(document)


def test_quality_policy():
    assert QualityConfig.parse({"rules": [RULE]}).policy.min_pass_rate == 0.95
    config = QualityConfig.parse(
        {"rules": [RULE], "policy": {"fail_job_if_below_threshold": "false"}}, min_pass_rate=0.5)
    assert (config.policy.min_pass_rate, config.policy.fail_below) == (0.5, False)


def test_match_document():
    config = MatchConfig.parse({"blocking_keys": [{"expression": "a"}, {"expression": "b"}]})
    assert (config.key_sql, config.thresholds) == ("a", Thresholds(0.95, 0.80))
    assert MatchConfig.parse({"blocking_keys": [{"expression": "a"}]}, high=0.9).thresholds.high == 0.9
    for bad in ({}, {"blocking_keys": []}, {"blocking_keys": [{}]}):
        with pytest.raises(ConfigError):
            MatchConfig.parse(bad)


def test_lifecycle_needs_three_states():
    states = [{"name": n} for n in ("ACTIVE", "PROPOSED", "REJECTED", "MERGED")]
    assert "MERGED" in Lifecycle.parse({"states": states}).states
    with pytest.raises(ConfigError, match="REJECTED"):
        Lifecycle.parse({"states": states[:2]})


def test_documents_as_json_and_yaml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": [1, 2]}, indent=2))
    assert load_document(spark, str(tmp_path / "a.json")) == {"k": [1, 2]}
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("k:\n  - 1\n  - 2\n")
    assert load_document(spark, str(tmp_path / "b.yaml")) == {"k": [1, 2]}
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ConfigError):
        load_document(spark, str(tmp_path / "c.yaml"))
