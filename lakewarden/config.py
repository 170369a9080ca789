"""Governance artifacts as typed values.

Artifacts are small documents read once on the driver. Everything is checked here, so the
operators never meet a half-valid setting.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from lakewarden import fixed_values as fv
from lakewarden.sources.readers import read_small_text

try:
    import yaml
except ImportError:
    yaml = None


class ConfigError(ValueError):
    """A governance artifact is missing something or holds a value of the wrong kind."""


def _text(value: Any, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{what} must be a non-empty text, got {value!r}")
    return value


def _flag(value: Any, what: str) -> bool:
    words = {"true": True, "false": False}
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.strip().lower() in words:
        return words[value.strip().lower()]
    raise ConfigError(f"{what} must be true or false, got {value!r}")


def _share(value: Any, what: str) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{what} must be a number, got {value!r}") from None
    if isinstance(value, bool) or not 0.0 <= number <= 1.0:
        raise ConfigError(f"{what} must lie in 0..1, got {value!r}")
    return number


def _entries(document: Mapping[str, Any], key: str) -> list[Mapping[str, Any]]:
    found = document.get(key) or []
    if not isinstance(found, list) or not all(isinstance(e, Mapping) for e in found):
        raise ConfigError(f"{key} must be a list of mappings")
    return found


@dataclass(frozen=True)
class Contract:
    """Declared dataset: stamps plus the wanted type of each known column."""

    source: str = fv.DEFAULT_SOURCE
    dataset_name: str = fv.DEFAULT_DATASET
    classification: str = fv.DEFAULT_CLASSIFICATION
    types: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, document: Mapping[str, Any]) -> Contract:
        declared = document.get("schema") or []
        # Best effort by design: entries without a name or with an unknown type are left alone.
        types = {
            e["name"]: e["type"]
            for e in declared
            if isinstance(e, Mapping) and "name" in e and e.get("type") in fv.CONTRACT_TYPES
        }
        stamps = {
            k: document[k]
            for k in ("source", "dataset_name", "classification")
            if document.get(k) is not None
        }
        return cls(types=types, **stamps)


@dataclass(frozen=True)
class Rule:
    """A named SQL condition that good rows meet."""

    name: str
    sql: str


@dataclass(frozen=True)
class QualityPolicy:
    min_pass_rate: float = fv.DEFAULT_MIN_PASS_RATE
    fail_below: bool = True


@dataclass(frozen=True)
class QualityConfig:
    rules: tuple[Rule, ...]
    policy: QualityPolicy = QualityPolicy()
    version: str | None = None

    @classmethod
    def parse(cls, document: Mapping[str, Any],
              min_pass_rate: float | None = None) -> QualityConfig:
        rules = tuple(
            Rule(_text(e.get("id"), "rule id"), _text(e.get("expression_sql"), "expression_sql"))
            for e in _entries(document, "rules")
        )
        if not rules:
            raise ConfigError("the quality artifact has no rules")
        if len({r.name.lower() for r in rules}) < len(rules):
            raise ConfigError("rule ids must be unique, whatever their case")
        given = document.get("policy") or {}
        wanted = given.get("default_min_pass_rate", fv.DEFAULT_MIN_PASS_RATE)
        policy = QualityPolicy(
            _share(wanted if min_pass_rate is None else min_pass_rate, "minimum pass rate"),
            _flag(given.get("fail_job_if_below_threshold", True), "fail_job_if_below_threshold"),
        )
        return cls(rules, policy, document.get("version"))


@dataclass(frozen=True)
class Thresholds:
    high: float = fv.HIGH_CONFIDENCE
    medium: float = fv.MEDIUM_CONFIDENCE


@dataclass(frozen=True)
class MatchConfig:
    key_sql: str
    thresholds: Thresholds = Thresholds()
    version: str | None = None

    @classmethod
    def parse(cls, document: Mapping[str, Any], high: float | None = None,
              medium: float | None = None) -> MatchConfig:
        keys = _entries(document, "blocking_keys")
        if not keys:
            raise ConfigError("the match artifact has no blocking_keys")
        # Only the first blocking key counts.
        key_sql = _text(keys[0].get("expression"), "blocking key expression")
        given = document.get("thresholds") or {}
        if high is None:
            high = given.get("high_confidence_auto_merge", fv.HIGH_CONFIDENCE)
        if medium is None:
            medium = given.get("medium_confidence_steward_review", fv.MEDIUM_CONFIDENCE)
        thresholds = Thresholds(
            _share(high, "high confidence"), _share(medium, "medium confidence"),
        )
        return cls(key_sql, thresholds, document.get("version"))


@dataclass(frozen=True)
class Lifecycle:
    states: frozenset[str]
    version: str | None = None

    @classmethod
    def parse(cls, document: Mapping[str, Any]) -> Lifecycle:
        states = frozenset(e["name"] for e in _entries(document, "states") if "name" in e)
        absent = [s for s in fv.REQUIRED_STATES if s not in states]
        if absent:
            raise ConfigError(f"the lifecycle artifact lacks the states {absent}")
        return cls(states, document.get("version"))


def load_document(spark: SparkSession, path: str) -> dict[str, Any]:
    """One artifact from any folder Spark can read. JSON is tried first; YAML needs its parser."""
    text = read_small_text(spark, path)
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        if yaml is None:
            raise ConfigError(f"{path} is not JSON and no YAML parser is installed") from None
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ConfigError(f"{path} does not hold a mapping")
    return found
