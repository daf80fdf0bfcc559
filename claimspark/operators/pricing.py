"""Repair pricing: fuzzy part prices with damage context, and the workshop catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import choose, clamp_parts, half_even, half_up


def named_cost(name: Column) -> Column:
    """Reduced base price of a trimmed lower-case label: exact part name, else the first
    table entry that contains the label or is contained in it, else the default."""
    price = lambda c: int(c * K.PRICE_REDUCTION + 0.5)
    exact = choose(name, {k: price(v) for k, v in K.BASE_REPAIR_COST.items()}, F.lit(None).cast("int"))
    partial = [F.when(F.contains(name, F.lit(k)) | F.contains(F.lit(k), name), F.lit(price(v)))
               for k, v in K.BASE_REPAIR_COST.items()]
    return F.coalesce(exact, *partial, F.lit(price(K.DEFAULT_REPAIR_COST))).cast("bigint")


def with_base_cost(df: DataFrame) -> DataFrame:
    """Add ``base_cost`` of ``label``; the lowered name is one column, evaluated once."""
    return (df.withColumn("_name", F.trim(F.lower("label")))
            .withColumn("base_cost", named_cost(F.col("_name"))).drop("_name"))


def severity_multiplier(severity: Column) -> Column:
    return choose(effective_severity(severity), K.SEVERITY_MULTIPLIER, F.lit(1.0))


def effective_severity(severity: Column) -> Column:
    return F.coalesce(F.nullif(severity, F.lit("")), F.lit("moderate"))


def context_multiplier(location: Column, extent: Column, parts: Column) -> Column:
    """Extent x location x affected parts, rounded half-up to two decimals."""
    n = clamp_parts(parts, K.PRICED_PARTS_MAX)
    by_parts = F.least(F.lit(K.PARTS_CEILING), F.lit(1.0) + (n - 1) * F.lit(K.PARTS_STEP))
    combined = (choose(extent, K.EXTENT_MULTIPLIER, F.lit(1.0))
                * choose(location, K.LOCATION_MULTIPLIER, F.lit(1.0)) * by_parts)
    return half_up(combined * 100) / F.lit(100.0)


def repair_items(det: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One priced line per detection; severity ``none`` is not repaired."""
    rows = det.where(effective_severity(F.col("severity")) != "none")
    if context is None:
        rows = rows.withColumn("context_multiplier", F.lit(1.0))
    else:
        ctx = context.select("claim_id", context_multiplier(
            F.col("location"), F.col("extent"), F.col("parts_count")).alias("context_multiplier"))
        rows = rows.join(ctx, "claim_id", "left").withColumn(
            "context_multiplier", F.coalesce("context_multiplier", F.lit(1.0)))
    parts = half_up(F.col("base_cost") * F.col("severity_multiplier") * F.col("context_multiplier"))
    return (with_base_cost(rows).withColumn("severity", effective_severity(F.col("severity")))
            .withColumn("severity_multiplier", severity_multiplier(F.col("severity")))
            .withColumn("parts_cost", parts)
            .withColumn("labour_cost", F.greatest(F.lit(K.LABOUR_MINIMUM).cast("bigint"),
                                                  half_up(F.col("parts_cost") * F.lit(K.LABOUR_RATE)))))


def repair_estimate(det: DataFrame, context: DataFrame) -> DataFrame:
    """Cost breakdown of every claim in ``context``; zero when nothing is to repair."""
    sums = repair_items(det).select("claim_id", "base_cost", "severity_multiplier")
    ctx = context.select("claim_id", context_multiplier(
        F.col("location"), F.col("extent"), F.col("parts_count")).alias("context_multiplier"))
    per_claim = sums.groupBy("claim_id", "base_cost", "severity_multiplier").agg(F.count(F.lit(1)).alias("k"))
    priced = ctx.join(per_claim, "claim_id", "left")
    unit = half_up(F.col("base_cost") * F.col("severity_multiplier") * F.col("context_multiplier"))
    labour = F.greatest(F.lit(K.LABOUR_MINIMUM).cast("bigint"), half_up(F.col("unit") * F.lit(K.LABOUR_RATE)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return (priced.withColumn("unit", unit).withColumn("labour", labour)
            .groupBy("claim_id", "context_multiplier").agg(
                zero(F.sum("k")).alias("items"),
                zero(F.sum(F.col("unit") * F.col("k"))).alias("parts_cost"),
                zero(F.sum(F.col("labour") * F.col("k"))).alias("labour_cost"))
            .withColumn("inspection_fee", F.lit(0).cast("bigint"))
            .withColumn("subtotal", F.col("parts_cost") + F.col("labour_cost"))
            .withColumn("gst", half_up(F.col("subtotal") * F.lit(K.GST_RATE)))
            .withColumn("total_cost", F.col("subtotal") + F.col("gst")))


def catalog_price(label: Column, severity: Column) -> Column:
    """Workshop catalogue price by case-insensitive label and severity band."""
    word = F.trim(F.lower(F.coalesce(severity, F.lit("none"))))
    # A leading blank keeps the band name lower-case after capitalising, so it has no price.
    cap = F.coalesce(severity, F.lit("none"))
    band = F.trim(F.concat(F.upper(F.substring(cap, 1, 1)), F.lower(F.substr(cap, F.lit(2)))))
    table = None
    for name, costs in K.WORKSHOP_CATALOG.items():
        bands = F.when(band == "Minor", costs[0]).when(band == "Moderate", costs[1]).when(band == "Severe", costs[2])
        for sev, (lo, hi, at) in K.CATALOG_INTERPOLATION.items():
            bands = bands.when(word == sev, half_even(F.lit(costs[lo] + (costs[hi] - costs[lo]) * at)).cast("int"))
        priced = F.when(word.isin(*K.CATALOG_ZERO_WORDS), F.lit(0)).otherwise(F.coalesce(bands, F.lit(0)))
        hit = F.lower(F.trim(label)) == name.lower()
        table = F.when(hit, priced) if table is None else table.when(hit, priced)
    return table.otherwise(F.lit(K.CATALOG_FALLBACK)).cast("bigint")
