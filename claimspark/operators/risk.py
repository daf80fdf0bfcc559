"""Claim risk: four scored layers over the detections of a claim, one aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import half_up


def plausibility(det: DataFrame) -> DataFrame:
    """Label pairs per claim and how many of them are implausible.

    The list of plausible pairs is symmetric and has no equal-label pair, so the number
    of plausible pairs is a sum of products of label counts. Pairs are never enumerated.
    """
    return _label_counts(det).select("claim_id", "n", *_pair_columns())


def _vocabulary() -> list[str]:
    return sorted({w for pair in K.PLAUSIBLE_PAIRS for w in pair})


def _label_counts(det: DataFrame, *extra: Column) -> DataFrame:
    name = F.trim(F.lower(F.col("label")))
    words = [F.count_if(name == w).alias(f"c_{w}") for w in _vocabulary()]
    return det.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), *words, *extra)


def _pair_columns() -> list[Column]:
    total = F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    plausible = sum((F.col(f"c_{a}") * F.col(f"c_{b}") for a, b in K.PLAUSIBLE_PAIRS), F.lit(0))
    return [total.alias("pairs"), (total - plausible).cast("bigint").alias("implausible_pairs")]


def risk_score(det: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Layer scores, layer confidences and the total per claim.

    ``claims`` adds claims without any detection.
    """
    severe = F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("moderate")) == "severe"
    rows = _label_counts(det, F.count_if(severe & (F.col("confidence") < 0.6)).alias("doubtful"),
                         F.round(F.avg("confidence"), 9).alias("mean_conf"))
    rows = rows.select("claim_id", "n", "doubtful", "mean_conf", *_pair_columns())
    if claims is not None:
        rows = claims.select("claim_id").join(rows, "claim_id", "left").fillna(
            0, ["n", "doubtful", "pairs", "implausible_pairs"])
    n, avg, none = F.col("n"), F.col("mean_conf"), F.col("n") == 0
    ratio = F.col("implausible_pairs") / F.nullif(F.col("pairs"), F.lit(0))
    consistency = F.when(none, 0).when(n == 1, 2).otherwise(half_up(ratio * 25))
    count = F.when(none, 0).when(n <= 3, 2).when(n <= 6, 8).otherwise(20)
    conf = F.when(none, 0).when(avg >= 0.8, 2).when(avg >= 0.6, 8).when(avg >= 0.4, 16).otherwise(22)
    scored = (rows
              .withColumn("consistency_score", consistency.cast("bigint"))
              .withColumn("consistency_conf", F.when(none, "low").when(n == 2, "medium").otherwise("high"))
              .withColumn("severity_score", F.least(F.lit(25), F.col("doubtful") * 12).cast("bigint"))
              .withColumn("severity_conf", F.when(none, "low").when(F.col("doubtful") == 0, "high").otherwise("medium"))
              .withColumn("confidence_score", conf.cast("bigint"))
              .withColumn("confidence_conf", F.when(none, "low").when(avg >= 0.6, "high").otherwise("medium"))
              .withColumn("count_score", count.cast("bigint"))
              .withColumn("count_conf", F.when(n.between(1, 5), "high").otherwise("medium")))
    layers = ("consistency", "severity", "confidence", "count")
    total = sum((F.col(f"{x}_score") for x in layers), F.lit(0))
    weight = lambda c: F.when(c == "high", 1.0).when(c == "medium", 0.7).otherwise(0.4)
    overall = sum((weight(F.col(f"{x}_conf")) for x in layers), F.lit(0.0)) / 4
    return (scored.withColumn("total_score", total.cast("bigint"))
            .withColumn("risk_level", F.when(F.col("total_score") <= 25, "low")
                        .when(F.col("total_score") <= 55, "medium").otherwise("high"))
            .withColumn("overall_confidence", half_up(overall * 100)))


def risk_layers(scored: DataFrame) -> DataFrame:
    """Long form: one row per claim and layer."""
    cols = ("consistency", "severity", "confidence", "count")
    entries = [F.struct(F.lit(i + 1).alias("layer_no"), F.lit(K.RISK_LAYERS[i]).alias("layer"),
                        F.col(f"{c}_score").alias("score"), F.col(f"{c}_conf").alias("confidence"))
               for i, c in enumerate(cols)]
    return scored.select("claim_id", F.inline(F.array(*entries)))
