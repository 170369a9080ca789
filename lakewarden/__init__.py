"""Data-governance operators for Spark tables: conform, enrich, check, match, audit."""
