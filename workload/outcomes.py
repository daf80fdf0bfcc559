"""Outcome, settlement and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import constants as K
from claimspark.functions import text as T
from claimspark.operators import audit as A
from claimspark.operators import detections as D
from claimspark.operators import outcome as O
from claimspark.operators import pricing as P

from claimspark.session import materialize

from .detections import ESTIMATE_CTE, KEEP_CTE, LABELS_CTE, case_sql, half_up_sql, values
from .registry import query

GATEWAY = """case claim_id % 7 when 0 then 'REJECTED_FRAUD' when 1 then 'NO_DAMAGE' else 'APPROVED_AUTHENTIC' end"""
OUTCOME_CTE = f"""{ESTIMATE_CTE},
gate as (select claim_id, {GATEWAY} as g, case when claim_id % 11 = 0 then 'FLAGGED' else 'PASSED' end as o,
    claim_id % 13 = 0 as r, claim_id % 101 as s, total_cost from estimate),
outcomes as (select claim_id,
  case when g = 'REJECTED_FRAUD' then 'FORENSIC_REJECTION' when g = 'NO_DAMAGE' then 'NO_DAMAGE_DETECTED'
    when o = 'FLAGGED' or r then 'REVIEW_REQUIRED' else 'DAMAGE_DETECTED' end as outcome,
  case when g = 'REJECTED_FRAUD' then 'rejected' when g = 'NO_DAMAGE' then 'no_damage'
    when o = 'FLAGGED' or r then 'review_required' else 'approved' end as stored_status,
  case when g = 'REJECTED_FRAUD' then 100 else s end as fraud_score,
  case when g = 'REJECTED_FRAUD' then 0 else total_cost end as estimated_cost from gate)"""


def _outcomes(t):
    c = F.col("claim_id")
    est = P.repair_estimate(t.detections, t.context).select(
        "claim_id", "total_cost", (c % 101).alias("total_score"), F.lit("low").alias("risk_level"),
        F.expr(GATEWAY).alias("gateway_status"), F.lit(None).cast("string").alias("legacy_status"),
        F.when(c % 11 == 0, "FLAGGED").otherwise("PASSED").alias("overall_status"), (c % 13 == 0).alias("replay_flagged"))
    return O.claim_outcome(est)


@query(f"with {OUTCOME_CTE} select claim_id, outcome, stored_status, fraud_score, estimated_cost from outcomes")
def claim_outcome(t):
    return _outcomes(t).select("claim_id", "outcome", "stored_status", "fraud_score", "estimated_cost")


@query(f"""with {OUTCOME_CTE} select claim_id, outcome = 'DAMAGE_DETECTED' and estimated_cost > 0 as eligible,
  estimated_cost as repair_value, {half_up_sql('estimated_cost * 0.95::double')} as cash_payout from outcomes""")
def settlement_option(t):
    return O.settlement_option(_outcomes(t)).select("claim_id", "eligible", "repair_value", "cash_payout")


SEV2 = case_sql("lower(coalesce(severity, 'none'))", K.SEVERITY_SCORE_V2, 0)
SEV1 = case_sql("coalesce(severity, 'moderate')", K.SEVERITY_SCORE_V1, 5)
AREA_CTE = f"""{KEEP_CTE}, {LABELS_CTE},
cost as (select claim_id, label, arg_min(greatest(0, {half_up_sql("base_cost * " + case_sql("coalesce(severity, 'moderate')", K.SEVERITY_MULTIPLIER, 1.0))}), keep_idx) as cost
  from kept join label_price using (label) where coalesce(severity, 'moderate') <> 'none' group by 1, 2)"""


def _areas(t, version):
    kept = materialize(D.dedupe_detections(t.detections))
    return O.damage_areas(kept, P.repair_items(kept), version)


@query(f"""with {AREA_CTE} select claim_id, 'DNG-' || lpad((keep_idx + 1)::varchar, 3, '0') as area_id,
  upper(label[1]) || label[2:] as title, {half_up_sql('confidence * 100')} as confidence_pct, cast({SEV2} as bigint) as severity_score,
  coalesce(cost, 0) as cost, round(least(100.0, x1 / 1280.0::double * 100), 4) as x, round(least(100.0, y1 / 720.0::double * 100), 4) as y,
  round(least(100.0, (x2 - x1) / 1280.0::double * 100), 4) as width, round(least(100.0, (y2 - y1) / 720.0::double * 100), 4) as height
from kept left join cost using (claim_id, label)""")
def damage_areas(t):
    return _areas(t, 2).select("claim_id", "area_id", "title", "confidence_pct", "severity_score", "cost",
                               *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


def v1_sql(expr, unit, default, lo, hi):
    return half_up_sql(f"greatest({lo}::double, least({hi}::double, coalesce(nullif(({expr}) / {unit}::double, 0), {default}::double)))")


@query(f"""with {AREA_CTE} select claim_id, keep_idx, cast({SEV1} as bigint) as severity_score, coalesce(cost, 0) as cost,
  {v1_sql('x1', 12.8, 10, 2, 85)} as x, {v1_sql('y1', 7.2, 10, 2, 85)} as y,
  {v1_sql('x2 - x1', 12.8, 20, 10, 60)} as width, {v1_sql('y2 - y1', 7.2, 20, 10, 60)} as height
from kept left join cost using (claim_id, label)""")
def damage_areas_fixed_frame(t):
    return _areas(t, 1).select("claim_id", "keep_idx", "severity_score", "cost", "x", "y", "width", "height")


@query("""select o_orderkey as claim_id, array_to_string(list_filter([
    case when o_orderkey % 6 = 0 then 'damage_types' end, case when o_orderkey % 5 = 0 then 'vehicle' end,
    case when o_orderkey % 17 = 0 then 'incident_at' end, null, case when o_orderkey % 9 = 0 then 'damage_location' end,
    case when o_orderkey % 14 = 0 then 'parts_count' end,
    case when o_orderkey % 17 <> 0 and o_orderdate > timestamp '1998-01-01' then 'future_incident' end], lambda v: v is not null), '|') as violations
from {orders}""")
def validate_intake(t):
    k = F.col("o_orderkey")
    form = t.orders.select(
        k.alias("claim_id"), F.when(k % 6 != 0, F.array(F.lit("dent"))).otherwise(F.array().cast("array<string>")).alias("damage_types"),
        F.when(k % 5 == 0, "  ").otherwise("car").alias("vehicle"), F.when(k % 17 != 0, F.col("o_orderdate")).alias("incident_at"),
        F.lit("road").alias("location"), F.when(k % 9 == 0, "").otherwise("front").alias("damage_location"), (k % 14).alias("parts_count"))
    out = O.intake_violations(form, F.lit("1998-01-01").cast("timestamp_ntz"))
    return out.select("claim_id", F.array_join("violations", "|").alias("violations"))


@query("""with c as (select *, 'CLM-' || claim_id as ref from {claims})
select claim_id from c where (lower(ref) like '%42%' or lower(customer_name) like '%42%' or lower(owner_id::varchar) like '%42%')
  and status = 'flagged'""")
def claim_search(t):
    c = t.claims.withColumn("ref", F.concat(F.lit("CLM-"), F.col("claim_id").cast("string")))
    hit = T.search_any(" 42 ", F.col("ref"), F.col("customer_name"), F.col("owner_id"))
    return c.where(hit & (F.col("status") == "flagged")).select("claim_id")


@query("""select claim_id, coalesce(nullif(case when claim_id % 3 = 0 then '' when claim_id % 3 = 1 then 'home' end, ''), 'auto') as type,
  coalesce(case when claim_id % 4 > 0 then estimated_cost end, 0.0::double) as estimated_cost, submitted_at::date::varchar as submitted
from {claims} where lower(claim_id::varchar) like '%home%' or lower(coalesce(nullif(case when claim_id % 3 = 0 then '' when claim_id % 3 = 1 then 'home' end, ''), 'auto')) like '%home%'
  or lower(status) like '%home%'""")
def history_search(t):
    k = F.col("claim_id")
    raw = t.claims.select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, "home").alias("type"), "status",
                          F.when(k % 4 > 0, F.col("estimated_cost")).alias("estimated_cost"),
                          F.when(k % 2 == 0, F.col("submitted_at")).alias("submitted_at"), F.col("submitted_at").alias("created_at"))
    out = O.history_rows(raw).where(T.search_any("Home", F.col("claim_id"), F.col("type"), F.col("status")))
    return out.select("claim_id", "type", "estimated_cost", F.to_date("submitted_at").cast("string").alias("submitted"))


@query(f"""select status, case status {' '.join(f"when '{k}' then '{v}'" for k, v in K.STATUS_LABELS.items())}
    else upper(replace(status, '_', ' ')) end as label, count(*) as n from {{queue_claims}} group by 1, 2
union all select status, case when status = 'flagged' then 'REVIEW REQUIRED' when status = 'approved' then 'DAMAGE DETECTED'
    when status = 'rejected' then 'FORENSIC REJECTION' else upper(replace(status, '_', ' ')) end, count(*) from {{claims}} group by 1, 2""")
def status_labels(t):
    rows = t.queue_claims.select("status").unionAll(t.claims.select("status"))
    src = t.queue_claims.select("status", F.lit(0).alias("s")).unionAll(t.claims.select("status", F.lit(1).alias("s")))
    return (src.withColumn("label", T.status_label(F.col("status"))).groupBy("status", "label", "s")
            .agg(F.count(F.lit(1)).alias("n")).drop("s"))


@query("""select claim_id as raw_id, coalesce(nullif(substr(regexp_replace(raw, '[^A-Za-z0-9_-]', '', 'g'), 1, 80), ''), 'CLM-LOCAL-' || claim_id) as clean_id
from (select claim_id, case claim_id % 4 when 0 then 'CLM/ ' || claim_id || '#é' when 1 then '  ' when 2 then null else customer_name || repeat('x', 90) end as raw from {claims})""")
def sanitize_claim_id(t):
    k = F.col("claim_id")
    raw = (F.when(k % 4 == 0, F.concat(F.lit("CLM/ "), k.cast("string"), F.lit("#é"))).when(k % 4 == 1, "  ")
           .when(k % 4 == 3, F.concat("customer_name", F.lit("x" * 90))))
    return t.claims.select(k.alias("raw_id"), T.sanitize_claim_id(raw, F.concat(F.lit("CLM-LOCAL-"), k.cast("string"))).alias("clean_id"))


# ---- audit ------------------------------------------------------------------------
ROLL_CTE = f"""fail as (select claim_id, min(stage) filter (where raw_status = 'FAILED') as f from {{stage_results}} group by 1),
rolled as (select claim_id, s.stage, n.name, case when f is null then 'PASSED' else 'FAILED' end as overall,
  case when f is null or f > s.stage then raw_status when f = s.stage then 'FAILED' else 'SKIPPED' end as status,
  case when f = s.stage then error_code end as error_code
  from {{stage_results}} s join fail using (claim_id) join {values(list(enumerate(K.STAGE_NAMES, 1)))} n(stage, name) on n.stage = s.stage)"""


@query(f"with {ROLL_CTE} select * from rolled")
def audit_rollup(t):
    return A.audit_rollup(t.stage_results)


@query(f"""with {ROLL_CTE} select claim_id, f is null as approved,
  case when f is null then 'APPROVED_AUTHENTIC' else 'REJECTED_FRAUD' end as status, f as failed_layer,
  max(error_code) filter (where stage = f) as error_code from {{stage_results}} join fail using (claim_id) group by claim_id, f""")
def audit_summary(t):
    return A.audit_summary(t.stage_results)


@query(f"""with {ROLL_CTE} select stage, name, count(*) filter (where status = 'PASSED') as passed,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status <> 'SKIPPED') as executed,
  round(100.0::double * count(*) filter (where status = 'PASSED') / nullif(count(*) filter (where status <> 'SKIPPED'), 0), 6) as pass_rate
from rolled group by 1, 2""")
def stage_pass_rates(t):
    from claimspark.operators.dashboards import stage_pass_rates as rates

    return rates(A.audit_rollup(t.stage_results)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"""with {ROLL_CTE} select claim_id, case
  when bool_and(status = 'PASSED') filter (where not (stage = 5 and status = 'SKIPPED')) then 'Checks complete'
  when bool_or(status = 'FAILED') then 'Security Failure' when bool_and(status = 'SKIPPED') then 'Not Available' else 'Manual Review' end as badge
from rolled group by 1""")
def audit_badge(t):
    return A.audit_badge(A.audit_rollup(t.stage_results))


@query("""select claim_id, count(*) filter (where bad) = 0 as passed, min(det_seq) filter (where bad) as frame_index,
  case when count(*) filter (where bad) > 0 then 'Frame ' || (min(det_seq) filter (where bad)) || ': ' || (arg_min(label, det_seq) filter (where bad)) end as reason
from (select *, confidence < 0.4 as bad from {detections}) group by 1""")
def frame_audit(t):
    return A.first_failing_frame(t.detections.select("claim_id", F.col("det_seq").alias("frame_index"),
                                                     (F.col("confidence") >= 0.4).alias("passed"), F.col("label").alias("reason")))


@query("""select claim_id, stage as failed_layer, 'Layer ' || stage as layer,
  coalesce(nullif(case when claim_id % 3 = 0 then 'text diag' end, ''), case when claim_id % 3 = 1 then 'why' end, 'Layer ' || stage || ' Failed') as reason,
  case when claim_id % 2 = 0 then 'SCREEN_RECORDING_REJECTED' else error_code end as error_code, 'FAILED' as status
from {stage_results} where raw_status = 'FAILED'""")
def build_failure(t):
    k = F.col("claim_id")
    diag = t.stage_results.where(F.col("raw_status") == "FAILED").select(
        k, "stage", F.when(k % 3 == 0, "text diag").alias("message"), F.when(k % 3 == 1, "why").alias("reason"),
        F.when(k % 2 == 0, "SCREEN_RECORDING_REJECTED").alias("error_code"))
    return A.failure_record(diag).select("claim_id", "failed_layer", "layer", "reason", "error_code", "status")


@query(f"""select o_orderkey as claim_id, case when o_orderkey % 5 = 0 then 'FAILED' else 'FLAGGED' end as "overallStatus",
  case when o_orderkey % 3 = 0 then 1 else 2 end as "schemaVersion",
  case o_orderkey % 4 when 0 then strftime(to_timestamp(1700000000 + o_orderkey) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z')
    when 1 then '2024-01-01T00:00:00Z' when 2 then (1700000000 + o_orderkey)::varchar else '2024-06-01T00:00:00.000Z' end as timestamp,
  case when o_orderkey % 7 = 0 then 'WARNING' else 'SKIPPED' end as first_status,
  'Layer 2: Duplicate and motion fingerprint' as second_name, case when o_orderkey % 2 = 0 then 'p' || o_orderkey end as label, o_orderkey % 11 as value from {{orders}}""")
def normalize_audit(t):
    """Numbers are epochs, numbers in quotes are not; stages under their keys, or in an array as older records have them."""
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "WARNING").otherwise("bogus")
    first = F.format_string('{"stage":1,"name":"x","status":"%s","details":"","metricValue":%d%s}', status, k % 11,
                            F.when(k % 2 == 0, F.format_string(',"metricLabel":"p%d"', k)).otherwise(""))
    time = F.when(k % 4 == 0, F.format_string(',"timestamp":%d', k + 1700000000)).when(k % 4 == 1, ',"timestamp":"2024-01-01T00:00:00Z"').when(
        k % 4 == 2, F.format_string(',"timestamp":"%d"', k + 1700000000)).otherwise("")
    report = F.concat(F.when(k % 2 == 0, F.format_string('{"stage1_exif":%s', first)).otherwise(F.format_string('{"stages":[%s]', first)), time,
                      F.when(k % 5 != 0, ',"overallStatus":"FLAGGED"').otherwise(""), F.when(k % 3 == 1, ',"schema_version":2').when(k % 3 == 2, ',"schemaVersion":2').otherwise(""), F.lit("}"))
    out = A.normalize_audit(t.orders.select(k.alias("claim_id"), F.parse_json(report).alias("report")), now=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    one = F.col("stages")[0]
    return out.select("claim_id", "overallStatus", "schemaVersion", "timestamp", one["status"].alias("first_status"), F.col("stages")[1]["name"].alias("second_name"),
                      F.variant_get(one["metricLabel"], "$", "string").alias("label"), F.variant_get(one["metricValue"], "$", "bigint").alias("value"))
