"""Claim outcome, settlement, damage areas and form validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import clamp, half_up, severity_score
from ..functions.text import nonempty
from .detections import first_by_label

REJECTED_STATES = ("REJECTED_FRAUD", "FRAUD_DETECTED")


def claim_outcome(df: DataFrame) -> DataFrame:
    """Adds ``outcome, stored_status, fraud_score, risk_level, estimated_cost``.

    Reads ``gateway_status, legacy_status, overall_status, replay_flagged, total_score,
    risk_level, total_cost``. A forensic rejection outranks no damage, which outranks
    review.
    """
    false = F.lit(False)
    rejected = (F.coalesce(F.col("gateway_status").isin(*REJECTED_STATES), false)
                | F.coalesce(F.col("legacy_status") == "FRAUD_DETECTED", false))
    empty = F.coalesce(F.col("gateway_status") == "NO_DAMAGE", false)
    review = F.coalesce(F.col("overall_status") == "FLAGGED", false) | F.coalesce("replay_flagged", false)
    pick = lambda r, n, v, d: F.when(rejected, r).when(empty, n).when(review, v).otherwise(d)
    return (df.withColumn("outcome", pick("FORENSIC_REJECTION", "NO_DAMAGE_DETECTED", "REVIEW_REQUIRED", "DAMAGE_DETECTED"))
            .withColumn("stored_status", pick("rejected", "no_damage", "review_required", "approved"))
            .withColumn("fraud_score", F.when(rejected, F.lit(100)).otherwise(F.col("total_score")).cast("bigint"))
            .withColumn("risk_level", F.when(rejected, "high").otherwise(F.col("risk_level")))
            .withColumn("estimated_cost", F.when(rejected, F.lit(0)).otherwise(F.col("total_cost")).cast("bigint")))


def settlement_option(df: DataFrame) -> DataFrame:
    """Adds ``eligible, repair_value, cash_payout`` from ``outcome`` and ``estimated_cost``."""
    cost = F.coalesce("estimated_cost", F.lit(0))
    return (df.withColumn("eligible", (F.col("outcome") == "DAMAGE_DETECTED") & (cost > 0))
            .withColumn("repair_value", cost)
            .withColumn("cash_payout", half_up(cost * F.lit(0.95))))


def damage_areas(kept: DataFrame, cost_items: DataFrame, version: int = 2,
                 source_width: Column | None = None, source_height: Column | None = None) -> DataFrame:
    """Display rows of the retained detections: id, title, severity score, cost, box in percent.

    Version 2 scales by the source size and clamps to 0..100. Version 1 assumes 1280x720,
    replaces zero by a default, clamps position to 2..85 and size to 10..60, and rounds.
    """
    priced = first_by_label(kept, cost_items, "keep_idx", ["parts_cost"])
    label = F.col("label")
    title = F.when(F.coalesce(label, F.lit("")) == "", "Damage Area").otherwise(
        F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2))))
    if version == 2:
        side = lambda given, usual: F.greatest(F.lit(1.0), F.lit(usual) if given is None else F.coalesce(given, F.lit(usual)))
        w, h = side(source_width, 1280.0), side(source_height, 720.0)
        pct = lambda v, side: clamp(v / side * 100, 0.0, 100.0)
        box = {"x": pct(F.col("x1"), w), "y": pct(F.col("y1"), h),
               "width": pct(F.col("x2") - F.col("x1"), w), "height": pct(F.col("y2") - F.col("y1"), h)}
        severity = F.coalesce("severity", F.lit("none"))
    else:
        def pct(v, unit, default, lo, hi):
            scaled = F.coalesce(F.nullif(v / F.lit(unit), F.lit(0.0)), F.lit(default))
            return half_up(clamp(scaled, lo, hi))

        box = {"x": pct(F.col("x1"), 12.8, 10.0, 2.0, 85.0), "y": pct(F.col("y1"), 7.2, 10.0, 2.0, 85.0),
               "width": pct(F.col("x2") - F.col("x1"), 12.8, 20.0, 10.0, 60.0),
               "height": pct(F.col("y2") - F.col("y1"), 7.2, 20.0, 10.0, 60.0)}
        severity = F.coalesce("severity", F.lit("moderate"))
    return priced.select(
        "claim_id", "keep_idx", F.format_string("DNG-%03d", (F.col("keep_idx") + 1).cast("int")).alias("area_id"),
        title.alias("title"), half_up(F.coalesce("confidence", F.lit(0.0)) * 100).alias("confidence_pct"),
        severity_score(severity, version).alias("severity_score"),
        F.coalesce("parts_cost", F.lit(0)).cast("bigint").alias("cost"),
        severity.alias("severity_label"), *[v.alias(k) for k, v in box.items()])


def intake_violations(df: DataFrame, now: Column) -> DataFrame:
    """Adds ``violations``: the rules an intake form breaks, in form order."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [
        ("damage_types", F.coalesce(F.size("damage_types"), F.lit(0)) < 1),
        ("vehicle", blank("vehicle")), ("incident_at", F.col("incident_at").isNull()),
        ("location", blank("location")), ("damage_location", F.coalesce(F.col("damage_location"), F.lit("")) == ""),
        ("parts_count", F.coalesce(F.col("parts_count"), F.lit(0)) < 1),
        ("future_incident", F.coalesce(F.col("incident_at") > now, F.lit(False))),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])))


def history_rows(df: DataFrame) -> DataFrame:
    """Display defaults of a stored claim: type, cost and the first known date."""
    return (df.withColumn("type", F.coalesce(nonempty(F.col("type")), F.lit("auto")))
            .withColumn("estimated_cost", F.coalesce("estimated_cost", F.lit(0.0)))
            .withColumn("submitted_at", F.coalesce(*[c for c in ("submitted_at", "created_at", "date") if c in df.columns])))
