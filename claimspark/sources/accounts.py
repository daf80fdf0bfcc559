"""Account-scoped JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import STAGES, audit_struct, audit_variant, stage_reports
from ..operators.queue import owner_of

LISTS = ("detections", "detection_frames", "damageAreas")


def account_rows(df: DataFrame, value_schema: str, defaults: dict[str, Column], owner: str | None = None) -> DataFrame:
    """Rows of one account (all accounts when ``owner`` is None) with parsed JSON values.

    A missing owner is the local default account. Unreadable JSON and missing fields take
    the defaults. The owner filter reaches a table partitioned by ``owner_id``.
    """
    rows = df if owner is None else df.where(F.col("owner_id") == owner)
    parsed = F.from_json("value_json", value_schema, {"mode": "PERMISSIVE"})
    rows = rows.withColumn("owner_id", owner_of(F.col("owner_id"))).withColumn("value", parsed)
    fields = rows.schema["value"].dataType.names
    full = F.struct(*[F.coalesce(F.col("value")[n], defaults[n]).alias(n) if n in defaults else F.col("value")[n].alias(n)
                      for n in fields])
    return rows.withColumn("value", full).drop("value_json")


def parse_stored_analysis(df: DataFrame, raw: str, now: Column | None = None) -> DataFrame:
    """Adds ``analysis`` (VARIANT): NULL for unreadable JSON and values that are no object, else the whole record.

    Unknown fields stay as they are, at any depth. Lists are never missing, reasons are texts, and the security report is
    normalised (:func:`audit.audit_struct`). ``to_json`` writes the record back.
    """
    # What many fields read is a column of its own step, and evaluated once a row: the text, the report, its stages.
    parsed = df.withColumn("_v_text", F.try_parse_json(F.col(raw)))
    parsed = parsed.withColumn("_v", F.when(F.schema_of_variant("_v_text").startswith("OBJECT"), F.col("_v_text"))).drop("_v_text")
    parsed = parsed.withColumn("_v_report", F.try_variant_get("_v", "$.fiveStageSecurity", "variant"))
    stages = [f"_v_stage{n}" for n in STAGES]
    parsed = parsed.withColumns(dict(zip(stages, stage_reports(F.col("_v_report")))))
    v = F.col("_v")
    of = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    empty = F.array().cast("array<variant>")
    lists = [x for name in LISTS for x in (F.lit(name), F.to_variant_object(F.coalesce(of(name, "array<variant>"), empty)))]
    reasons = F.transform(F.coalesce(of("modelReasoning", "array<variant>"), empty), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")))
    report = audit_variant(audit_struct(F.col("_v_report"), F.current_timestamp() if now is None else now, [F.col(c) for c in stages]))
    known = F.create_map(*lists, F.lit("modelReasoning"), F.to_variant_object(reasons), F.lit("fiveStageSecurity"), report)
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*LISTS, "modelReasoning", "fiveStageSecurity"))
    return parsed.withColumn("analysis", F.when(v.isNotNull(), F.to_variant_object(F.map_concat(others, known)))).drop("_v", "_v_report", *stages)
