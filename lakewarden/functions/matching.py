"""Name normalization, similarity and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden import fixed_values as fv
from lakewarden.config import Thresholds


def normalized(text: Column) -> Column:
    """Upper case, each run of other characters than A-Z and 0-9 as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.upper(text.cast("string")), "[^A-Z0-9]+", " "))


def composite_key(*parts: Column) -> Column:
    """Parts joined by the key separator; NULL parts are left out, as concat_ws does."""
    return F.concat_ws(fv.KEY_SEPARATOR, *parts)


def first_token(name: Column) -> Column:
    return F.split(name, " ").getItem(0)


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, rounded; 0.0 where both names are empty, NULL if one is."""
    longer = F.greatest(F.length(left), F.length(right))
    ratio = F.levenshtein(left, right) / F.nullif(longer, F.lit(0))
    return F.when(F.length(left) + F.length(right) == 0, 0.0).otherwise(F.round(1 - ratio, fv.SCORE_DIGITS))


def token_agreement(left_token: Column, right_token: Column) -> Column:
    return F.when(left_token == right_token, 1.0).otherwise(0.0)


def pair_confidence(similarity: Column, agreement: Column) -> Column:
    weighted = similarity * F.lit(fv.NAME_WEIGHT) + agreement * F.lit(fv.TOKEN_WEIGHT)
    return F.round(weighted, fv.SCORE_DIGITS)


def group_confidence(group_size: Column) -> Column:
    """Confidence of a record by how many records share its key."""
    return F.when(group_size == 1, fv.UNIQUE_KEY_CONFIDENCE).otherwise(fv.SHARED_KEY_CONFIDENCE)


def decision(confidence: Column, thresholds: Thresholds) -> Column:
    """Ladder with inclusive steps; NULL confidence is a reject."""
    return (
        F.when(confidence >= thresholds.high, fv.AUTO_MERGE)
        .when(confidence >= thresholds.medium, fv.STEWARD_REVIEW)
        .otherwise(fv.REJECT)
    )
