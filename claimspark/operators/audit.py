"""Five-stage audit: failure records, roll-up, badges, normalised reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import choose

STAGES = range(1, 6)


def failure_record(df: DataFrame) -> DataFrame:
    """Uniform failure columns from a text or structured diagnostic.

    Reads ``stage, message, reason, error_code``; a plain-text diagnostic arrives as
    ``message`` alone.
    """
    reason = F.coalesce(F.nullif("message", F.lit("")), F.nullif("reason", F.lit("")),
                        F.format_string("Layer %d Failed", F.col("stage").cast("int")))
    code = F.coalesce(F.nullif("error_code", F.lit("")),
                      choose(F.col("stage"), K.STAGE_DEFAULT_CODES, F.lit("FRAUD_REJECTED")))
    return (df.withColumn("failed_layer", F.col("stage")).withColumn("layer", F.format_string("Layer %d", F.col("stage").cast("int")))
            .withColumn("reason", reason).withColumn("error_code", code).withColumn("status", F.lit("FAILED")))


def stage_name(stage: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in K.STAGE_NAMES]), stage)


def audit_rollup(checks: DataFrame) -> DataFrame:
    """Five ordered stage rows per claim from raw checks ``claim_id, stage, raw_status, error_code``.

    The first failing stage stops the audit and later stages become SKIPPED. A claim is
    approved when nothing failed. Several checks may belong to one stage; everything is
    one map-side combined aggregation.
    """
    order = ["check_no"] if "check_no" in checks.columns else []
    bad = F.col("raw_status") == "FAILED"
    first = F.min(F.when(bad, F.struct("stage", *order, "error_code")))
    rank = F.when(F.col("raw_status") == "WARNING", 3).when(F.col("raw_status") == "PASSED", 2).otherwise(1)
    per_stage = [F.max(F.when(F.col("stage") == s, rank)).alias(f"r{s}") for s in STAGES]
    rolled = checks.groupBy("claim_id").agg(first.alias("fail"), *per_stage)

    def entry(s: int) -> Column:
        failed = F.col("fail.stage")
        seen = F.when(F.col(f"r{s}") == 3, "WARNING").when(F.col(f"r{s}") == 2, "PASSED").otherwise("SKIPPED")
        status = F.when(failed.isNull() | (failed > s), seen).when(failed == s, "FAILED").otherwise("SKIPPED")
        return F.struct(F.lit(s).alias("stage"), F.lit(K.STAGE_NAMES[s - 1]).alias("name"), status.alias("status"),
                        F.when(failed == s, F.col("fail.error_code")).alias("error_code"))

    return (rolled.withColumn("overall", F.when(F.col("fail").isNull(), "PASSED").otherwise("FAILED"))
            .select("claim_id", "overall", F.inline(F.array(*[entry(s) for s in STAGES]))))


def audit_summary(checks: DataFrame) -> DataFrame:
    """One row per claim: overall status, failing layer and its error code."""
    bad = F.col("raw_status") == "FAILED"
    return (checks.groupBy("claim_id").agg(F.min(F.when(bad, F.struct("stage", "error_code"))).alias("f"))
            .select("claim_id", F.col("f").isNull().alias("approved"),
                    F.when(F.col("f").isNull(), "APPROVED_AUTHENTIC").otherwise("REJECTED_FRAUD").alias("status"),
                    F.col("f.stage").alias("failed_layer"), F.col("f.error_code").alias("error_code")))


def first_failing_frame(frames: DataFrame) -> DataFrame:
    """First frame (by index) that failed, with its reason; claims without one are clean."""
    bad = ~F.col("passed")
    return (frames.groupBy("claim_id").agg(F.min(F.when(bad, F.struct("frame_index", "reason"))).alias("f"))
            .select("claim_id", F.col("f").isNull().alias("passed"), F.col("f.frame_index").alias("frame_index"),
                    F.when(F.col("f").isNotNull(), F.concat(F.lit("Frame "), F.col("f.frame_index").cast("string"),
                                                            F.lit(": "), F.col("f.reason"))).alias("reason")))


def audit_badge(stages: DataFrame) -> DataFrame:
    """Badge of a five-stage audit; a skipped stage 5 does not count against a claim."""
    st = F.col("status")
    required = ~((F.col("stage") == 5) & (st == "SKIPPED"))
    agg = stages.groupBy("claim_id").agg(
        F.bool_and(F.when(required, st == "PASSED")).alias("ok"), F.bool_or(st == "FAILED").alias("failed"),
        F.bool_and(st == "SKIPPED").alias("unavailable"))
    return agg.select("claim_id", F.when(F.coalesce("ok", F.lit(False)), "Checks complete").when(F.col("failed"), "Security Failure")
                      .when(F.col("unavailable"), "Not Available").otherwise("Manual Review").alias("badge"))


def truthy(v: Column, path: str) -> Column:
    """Text of a VARIANT's field; NULL where it is missing, null, empty, zero or false."""
    text = F.try_variant_get(v, path, "string")
    zero = F.try_variant_get(v, path, "double") == 0
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    blank = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").otherwise(zero)
    return F.when(~F.coalesce(blank, F.lit(False)), text)


def stage_reports(v: Column) -> list[Column]:
    """The stored report of each stage of an audit report (VARIANT), found under its key or by place in an array ``stages``."""
    return [F.coalesce(F.try_variant_get(v, f"$.{K.STAGE_KEYS[n - 1]}", "variant"), F.try_variant_get(v, f"$.stages[{n - 1}]", "variant")) for n in STAGES]


def audit_struct(v: Column, now: Column, reports: list[Column] | None = None) -> Column:
    """A stored audit report (VARIANT) with every missing part set to its default.

    Stages are found under their keys, or by place in an array ``stages``. Numbers are epoch seconds; any other time is
    kept as written, and ``now`` stands for none. ``metricLabel`` and ``metricValue`` are kept as they are.
    ``reports`` are :func:`stage_reports` where they are columns already: many fields read each of them.
    """
    reports = stage_reports(v) if reports is None else reports
    epoch = F.when(~F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant")).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$.timestamp", "double"))
    iso = lambda t: F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    number = lambda path: F.nullif(F.try_variant_get(v, path, "string").try_cast("double"), F.lit(0.0)).cast("int")

    def stage(n: int) -> Column:
        key, short = K.STAGE_KEYS[n - 1], K.STAGE_SHORT_NAMES[n - 1]
        s = reports[n - 1]
        text = lambda c, default: F.coalesce(truthy(s, f"$.{c}"), F.lit(default))
        status = F.try_variant_get(s, "$.status", "string")
        return F.struct(F.lit(key).alias("key"), F.coalesce(F.nullif(F.try_variant_get(s, "$.stage", "string").try_cast("double"), F.lit(0.0)).cast("int"), F.lit(n)).alias("stage"),
                        text("name", f"Layer {n}: {short}").alias("name"), text("shortName", short).alias("shortName"),
                        F.when(status.isin(*K.STAGE_STATUSES), status).otherwise("SKIPPED").alias("status"),
                        text("details", "No result is available for this check.").alias("details"),
                        F.try_variant_get(s, "$.metricLabel", "variant").alias("metricLabel"), F.try_variant_get(s, "$.metricValue", "variant").alias("metricValue"))

    return F.struct(F.coalesce(truthy(v, "$.overallStatus"), F.lit("FAILED")).alias("overallStatus"),
                    F.coalesce(number("$.schema_version"), number("$.schemaVersion"), F.lit(1)).alias("schemaVersion"),
                    F.coalesce(iso(F.timestamp_millis(F.floor(epoch * 1000))), truthy(v, "$.timestamp"), iso(now)).alias("timestamp"),
                    F.array(*[stage(n) for n in STAGES]).alias("stages"))


def normalize_audit(df: DataFrame, raw: str = "report", now: Column | None = None) -> DataFrame:
    """Default every missing part of a stored audit report: VARIANT, or a struct of the same fields."""
    kind = df.schema[raw].dataType.typeName()
    v = F.col(raw) if kind == "variant" else F.to_variant_object(raw)
    audit = df.select(*[c for c in df.columns if c != raw], audit_struct(v, F.current_timestamp() if now is None else now).alias("_audit"))
    return audit.select(*[c for c in df.columns if c != raw], "_audit.*")


def audit_variant(audit: Column) -> Column:
    """The normalised report as VARIANT, its stages under their keys; absent metrics stay absent."""
    fields = ("stage", "name", "shortName", "status", "details", "metricLabel", "metricValue")
    as_variant = lambda s: F.to_variant_object(F.map_filter(F.map_from_arrays(
        F.array(*[F.lit(f) for f in fields]),
        F.array(*[s[f] if f.startswith("metric") else s[f].cast("variant") for f in fields])), lambda k, x: x.isNotNull()))
    head = [x for c in ("overallStatus", "schemaVersion", "timestamp") for x in (F.lit(c), audit[c].cast("variant"))]
    stages = [x for n in STAGES for x in (F.lit(K.STAGE_KEYS[n - 1]), as_variant(audit["stages"][n - 1]))]
    return F.to_variant_object(F.create_map(*head, *stages))
