"""Values that carry their source, and the decisions made from confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("ocr", "db_match", "user", "template", "inferred")


def round3(c: Column) -> Column:
    """Half up at three places, as the reference results are rounded."""
    return F.floor(c * 1000 + 0.5) / 1000


def extracted(value: Column, source: str, confidence: Column, evidence: Column) -> Column:
    """A value with its source, confidence and evidence.

    An unknown source is an error, so is a confidence outside 0..1 (at run time) and an inference without evidence.  Inferences
    are capped at 0.7, users are certain, and a missing value has confidence 0.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    conf = confidence.cast("double")
    checked = F.when(conf.isNull() | (conf < 0) | (conf > 1) | F.isnan(conf), F.raise_error(F.lit("confidence must be in [0, 1]")).cast("double")).otherwise(conf)
    if source == "inferred":
        checked = F.when(evidence.isNull() | (evidence == ""), F.raise_error(F.lit("an inference needs evidence")).cast("double")).otherwise(F.least(checked, F.lit(0.7)))
    if source == "user":
        checked = F.lit(1.0)
    given = F.nullif(value.cast("string"), F.lit(""))
    return F.struct(given.alias("value"), F.lit(source).alias("source"), F.when(given.isNull(), 0.0).otherwise(checked).alias("confidence"), evidence.cast("string").alias("evidence"))


def value_of(user: Column, field: Column) -> Column:
    return F.coalesce(user.cast("string"), field["value"])


def fill(field: Column, value: Column, confidence: Column, evidence: Column) -> Column:
    """A database value, only where nothing was read."""
    given = F.nullif(value.cast("string"), F.lit(""))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.when(F.coalesce(field["value"], F.lit("")) != "", field).when(given.isNull(), field).otherwise(extracted(value, "db_match", clamped, evidence))


def band(confidence: Column, margin: Column) -> Column:
    return F.when((confidence >= 0.9) & (margin >= 0.1), "HIGH").when(confidence >= 0.7, "MEDIUM").otherwise("LOW")


def auto_acceptable(confidence: Column, margin: Column, flags: Column) -> Column:
    return (band(confidence, margin) == "HIGH") & (F.size(flags) == 0)


def state_of(confidence: Column, margin: Column, flags: Column) -> Column:
    return F.when(auto_acceptable(confidence, margin, flags), "IDENTIFIED").otherwise("NEEDS_REVIEW")
