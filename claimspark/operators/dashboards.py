"""Operator dashboards: trends, patterns, regions, KPIs, team and settlement figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAUD = ("flagged", "rejected")


def is_fraud(status: Column) -> Column:
    return status.isin(*FRAUD)


def percent_change(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous) * 100.0 / previous)


def _per_period(claims: DataFrame, unit: str, *aggs: Column) -> DataFrame:
    return claims.groupBy(F.date_trunc(unit, "submitted_at").cast("date").alias("period")).agg(*aggs)


def _with_previous_period(rows: DataFrame, unit: str, measures: list[str]) -> DataFrame:
    """Percent change against the previous calendar period.

    The previous period is found by date, not by row, so a period without claims is not
    bridged. The window runs over one row per period.
    """
    w = Window.orderBy("period")
    before = F.add_months("period", -1) if unit == "month" else F.date_sub("period", 1)
    prev_date = F.lag("period").over(w)
    out = rows
    for m in measures:
        prev = F.when(prev_date == before, F.lag(m).over(w))
        out = out.withColumn(f"{m}_change_pct", percent_change(F.col(m), prev))
    return out


def fraud_trend(claims: DataFrame, months: int | None = 6) -> DataFrame:
    """Monthly totals, flagged and rejected claims; the latest ``months`` months."""
    trend = _per_period(claims, "month", F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("status") == "flagged").alias("flagged"),
                        F.count_if(F.col("status") == "rejected").alias("rejected"))
    return trend if months is None else trend.orderBy(F.desc("period")).limit(months)


def fraud_patterns(failures: DataFrame, kind: str = "error_code") -> DataFrame:
    """Failures per type and their share of all failures."""
    counts = failures.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def geo_distribution(claims: DataFrame) -> DataFrame:
    return (claims.where(is_fraud(F.col("status"))).groupBy("region")
            .agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "region"))


def daily_kpis(claims: DataFrame) -> DataFrame:
    """Claims, alerts, processed claims and savings per day with change to the day before."""
    st = F.col("status")
    days = _per_period(claims, "day", F.count(F.lit(1)).alias("claims"), F.count_if(st == "flagged").alias("alerts"),
                       F.count_if(st != "pending").alias("processed"),
                       F.sum(F.when(st == "rejected", F.col("estimated_cost")).otherwise(0.0)).alias("savings"))
    return _with_previous_period(days, "day", ["claims", "alerts", "processed", "savings"])


def monthly_fraud_kpis(claims: DataFrame) -> DataFrame:
    st = F.col("status")
    months = _per_period(claims, "month", F.count_if(is_fraud(st)).alias("fraudulent"),
                         F.sum(F.when(st == "rejected", F.col("estimated_cost")).otherwise(0.0)).alias("saved"),
                         (F.count_if(st == "rejected") * 100.0 / F.nullif(F.count_if(is_fraud(st)), F.lit(0))).alias("detection_rate"))
    return _with_previous_period(months, "month", ["fraudulent", "saved"])


def stage_pass_rates(stages: DataFrame) -> DataFrame:
    """Pass rate per audit stage; skipped stages are not part of the denominator."""
    st = F.col("status")
    return (stages.groupBy("stage", "name").agg(
        F.count_if(st == "PASSED").alias("passed"), F.count_if(st == "FAILED").alias("failed"),
        F.count_if(st != "SKIPPED").alias("executed"))
        .withColumn("pass_rate", F.col("passed") * 100.0 / F.nullif("executed", F.lit(0))))


def settlement_kpis(settlements: DataFrame, today: Column) -> DataFrame:
    st = F.col("status")
    return settlements.agg(
        F.count_if(st == "processing").alias("pending"),
        F.count_if((st == "completed") & (F.to_date("completed_at") == today)).alias("completed_today"),
        F.sum("amount").alias("total_amount"))


def team_performance(claims: DataFrame) -> DataFrame:
    """Processed claims, approval rate and mean minutes per member, plus a total row.

    The total row carries the NULL member: grouping sets compute both in one pass.
    """
    st = F.col("status")
    processed = F.count_if(st != "pending")
    return (claims.rollup("member").agg(
        processed.alias("processed"),
        (F.count_if(st == "approved") * 100.0 / F.nullif(processed, F.lit(0))).alias("approval_rate"),
        F.avg(F.when(st != "pending", F.col("minutes"))).alias("avg_minutes"),
        F.count_distinct("member").alias("members")))


def status_counters(claims: DataFrame) -> DataFrame:
    st = F.col("status")
    return claims.groupBy("owner_id").agg(
        F.count_if(st.isin("processing", "pending_upload")).alias("pending"),
        F.count_if(st == "approved").alias("approved"), F.count_if(st == "rejected").alias("rejected"))


def recent_claims(claims: DataFrame, k: int = 5) -> DataFrame:
    return claims.orderBy(F.desc("submitted_at"), "claim_id").limit(k)
