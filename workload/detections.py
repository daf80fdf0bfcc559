"""Detection, pricing and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import constants as K
from claimspark.functions import numbers as N
from claimspark.functions import text as T
from claimspark.functions.similarity import box_iou
from claimspark.operators import detections as D
from claimspark.operators import pricing as P
from claimspark.operators import risk as R
from claimspark.session import materialize

from .registry import query


def values(rows) -> str:
    lit = lambda v: "null" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def label_sql(expr: str) -> str:
    flat = f"trim(regexp_replace(translate(lower({expr}), '_-', '  '), '\\s+', ' ', 'g'))"
    arms = " ".join(f"when {flat} like '%{w}%' then '{n}'" for w, n in T.LABEL_KEYWORDS)
    return f"case {arms} else {flat} end"


def half_up_sql(expr: str) -> str:
    return f"cast(floor(({expr}) + 0.5::double) as bigint)"


NORM = label_sql("label")


@query(f"select label, {NORM} as label_norm, count(*) as n from {{detections}} group by 1, 2")
def label_normalize(t):
    return (T.with_label_norm(t.detections.select("label"))
            .groupBy("label", "label_norm").agg(F.count(F.lit(1)).alias("n")))


ALLOWED_CTE = f"""allowed as (
  select claim_id, list_distinct(list_transform(list_filter(list_transform(
      string_split(replace(reported_damage_type, ';', ','), ','), lambda p: trim(p)), lambda p: p <> ''),
      lambda p: {label_sql('p')})) as names
  from {{context}} where reported_damage_type is not null
    and lower(trim(reported_damage_type)) not in ('', 'unspecified', 'all', 'none'))"""
KEPT_CTE = f"""kept as (
  select d.*, {label_sql('d.label')} as label_norm from {{detections}} d left join allowed a using (claim_id)
  where confidence >= 0.45 and (a.names is null or list_contains(a.names, {label_sql('d.label')})))"""


@query(f"with {ALLOWED_CTE} select c.claim_id, array_to_string(list_sort(names), '|') as names, "
       "names is null as unrestricted from {context} c left join allowed using (claim_id)")
def allowed_classes(t):
    names = T.allowed_classes(F.col("reported_damage_type"))
    return t.context.select("claim_id", F.array_join(F.sort_array(names), "|").alias("names"),
                            names.isNull().alias("unrestricted"))


@query(f"with {ALLOWED_CTE}, {KEPT_CTE} select claim_id, det_seq, label_norm, confidence from kept")
def filter_detections(t):
    return D.filter_detections(t.detections, t.context).select("claim_id", "det_seq", "label_norm", "confidence")


@query("""select vec_id, vec_id % 11 <> 0 and vec_id % 3 <> 1 as valid from {embeddings}""")
def valid_detections(t):
    """One box for every four values; a third of the payloads have one that is cut short."""
    size = lambda i: F.when((F.col("vec_id") % 3 == 1) & (i == F.col("vec_id") % 16), 2).otherwise(4)
    boxes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.slice("embedding", i * 4 + 1, size(i)).alias("bbox")))
    payload = F.when(F.col("vec_id") % 11 != 0, boxes)
    return t.embeddings.select("vec_id", D.valid_payload(payload).alias("valid"))


@query("""select claim_id, det_seq, x1 * 2.0::double as x1, y2 * 1.125::double as y2,
  x1 * 2.0::double / 1280 as x1_rel, y2 * 1.125::double / 720 as y2_rel from {detections}""")
def rescale_boxes(t):
    out = D.rescale_boxes(t.detections, F.lit(640.0), F.lit(640.0))
    return out.select("claim_id", "det_seq", "x1", "y2", "x1_rel", "y2_rel")


@query("""select event_id % 300 as fps, count(*) as kept from {events}
  where (event_id + 1) % greatest(1, floor((case when event_id % 300 between 1 and 240 then event_id % 300 else 30 end)
    ::double / 5)::int) = 0 group by 1""")
def sample_every(t):
    frames = t.events.select((F.col("event_id") % 300).alias("fps"), (F.col("event_id") + 1).alias("frame_index"))
    return D.sample_every(frames, F.col("fps")).groupBy("fps").agg(F.count(F.lit(1)).alias("kept"))


@query("""select o_orderkey as claim_id, idx from {orders}, lateral (
  select distinct cast(round_even(i * (o_orderkey % 40) / 11.0::double, 0) as bigint) as idx from range(12) r(i)) s""")
def sample_even(t):
    total = F.col("o_orderkey") % 40 + 1
    return t.orders.select(F.col("o_orderkey").alias("claim_id"), F.explode(D.even_positions(total, 12)).alias("idx"))


@query("""select claim_id, case when lower(trim(s)) in ('none','minor','semi_minor','moderate','semi_moderate',
    'semi_severe','severe') then lower(trim(s)) end as severity,
  coalesce(lower(trim(flag)) in ('true','yes','1','flagged'), false) as flag
from (select claim_id, case when det_seq % 5 = 0 then upper(severity) || ' ' when det_seq % 5 = 1 then 'broken'
  else severity end as s, case det_seq % 4 when 0 then 'Yes ' when 1 then 'FLAGGED' when 2 then 'no' end as flag
  from {detections})""")
def normalize_severity_and_flags(t):
    seq = F.col("det_seq")
    raw = F.when(seq % 5 == 0, F.concat(F.upper("severity"), F.lit(" "))).when(seq % 5 == 1, "broken").otherwise(F.col("severity"))
    flag = F.when(seq % 4 == 0, "Yes ").when(seq % 4 == 1, "FLAGGED").when(seq % 4 == 2, "no")
    return t.detections.select("claim_id", T.normalize_severity(raw).alias("severity"), T.normalize_bool(flag).alias("flag"))


@query("""select claim_id, greatest(1, least(12, parts_count)) as intake_parts,
  greatest(1, least(8, parts_count)) as priced_parts from {context}""")
def clamp_parts(t):
    p = F.col("parts_count")
    return t.context.select("claim_id", N.clamp_parts(p, 12).alias("intake_parts"), N.clamp_parts(p, 8).alias("priced_parts"))


@query(f"""select claim_id, det_seq, case severity when 'none' then 0 when 'minor' then 3 when 'moderate' then 6
    when 'severe' then 9 else 5 end as score_v1,
  coalesce((select s from {values(K.SEVERITY_SCORE_V2.items())} v(k, s) where k = lower(severity)), 0) as score_v2
  from {{detections}}""")
def severity_score(t):
    s = F.col("severity")
    return t.detections.select("claim_id", "det_seq", N.severity_score(s, 1).alias("score_v1"),
                               N.severity_score(s, 2).alias("score_v2"))


# ---- pricing -----------------------------------------------------------------
def case_sql(key: str, table: dict, default) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}::double" for k, v in table.items()) + f" else {default}::double end"


BASE_SQL = f"""(select cast(floor(min_by(c, prio) * 0.9::double + 0.5::double) as bigint) from (
    select c, o + case when k = lower(trim(label)) then -1000 else 0 end as prio
    from {values([(i, k, v) for i, (k, v) in enumerate(K.BASE_REPAIR_COST.items())] + [(999, None, K.DEFAULT_REPAIR_COST)])} b(o, k, c)
    where k is null or contains(lower(trim(label)), k) or contains(k, lower(trim(label)))))"""
LABELS_CTE = f"""label_price as (select label, {BASE_SQL} as base_cost
  from (select distinct label from {{detections}}))"""
CTX_CTE = f"""ctx as (select claim_id, {half_up_sql(
    case_sql('extent', K.EXTENT_MULTIPLIER, 1.0) + ' * ' + case_sql('location', K.LOCATION_MULTIPLIER, 1.0)
    + ' * least(1.5::double, 1.0::double + (greatest(1, least(8, parts_count)) - 1) * 0.08::double) * 100')} / 100.0::double
    as context_multiplier from {{context}})"""
ITEMS_CTE = f"""items as (
  select d.claim_id, d.det_seq, d.label, coalesce(severity, 'moderate') as severity, base_cost,
    {case_sql("coalesce(severity, 'moderate')", K.SEVERITY_MULTIPLIER, 1.0)} as severity_multiplier, context_multiplier
  from {{detections}} d join label_price using (label) join ctx using (claim_id)
  where coalesce(severity, 'moderate') <> 'none'),
priced as (select *, {half_up_sql('base_cost * severity_multiplier * context_multiplier')} as parts_cost from items),
lines as (select *, greatest(450, {half_up_sql('parts_cost * 0.15::double')}) as labour_cost from priced)"""
ESTIMATE_CTE = f"""{LABELS_CTE}, {CTX_CTE}, {ITEMS_CTE},
sums as (select c.claim_id, c.context_multiplier, count(l.claim_id) as items,
    cast(coalesce(sum(parts_cost), 0) as bigint) as parts_cost, cast(coalesce(sum(labour_cost), 0) as bigint) as labour_cost
  from ctx c left join lines l using (claim_id) group by 1, 2),
estimate as (select *, 0::bigint as inspection_fee, parts_cost + labour_cost as subtotal,
  {half_up_sql('(parts_cost + labour_cost) * 0.18::double')} as gst,
  parts_cost + labour_cost + {half_up_sql('(parts_cost + labour_cost) * 0.18::double')} as total_cost from sums)"""


@query(f"with {ESTIMATE_CTE} select * from estimate")
def repair_estimate(t):
    return P.repair_estimate(t.detections, t.context)


@query(f"with {ESTIMATE_CTE} select claim_id, det_seq, label, severity, base_cost, severity_multiplier, "
       "context_multiplier, parts_cost, labour_cost from lines")
def repair_items(t):
    return P.repair_items(t.detections, t.context).select(
        "claim_id", "det_seq", "label", "severity", "base_cost", "severity_multiplier",
        "context_multiplier", "parts_cost", "labour_cost")


@query(f"with {LABELS_CTE} select label, base_cost from label_price union all "
       f"select p_name as label, base_cost from (select distinct p_name from {{part}}) p, lateral (select {BASE_SQL.replace('label', 'p_name')} as base_cost) b")
def fuzzy_price(t):
    labels = t.detections.select("label").distinct().unionByName(t.part.select(F.col("p_name").alias("label")).distinct())
    return P.with_base_cost(labels)


@query(f"with {CTX_CTE} select claim_id, context_multiplier from ctx")
def context_rates(t):
    return t.context.select("claim_id", P.context_multiplier(
        F.col("location"), F.col("extent"), F.col("parts_count")).alias("context_multiplier"))


CATALOG_ROWS = [(k.lower(), *v) for k, v in K.WORKSHOP_CATALOG.items()]


@query(f"""select d.label, s as severity, cast(case when c.k is null then 3000
    when lower(trim(s)) in ('none', 'no damage', 'false', 'nothing', 'unclear') then 0
    when lower(trim(s)) = 'semi_minor' then round_even(mi + (mo - mi) * 0.40::double, 0)
    when lower(trim(s)) = 'semi_moderate' then round_even(mo + (se - mo) * 0.35::double, 0)
    when lower(trim(s)) = 'semi_severe' then round_even(mo + (se - mo) * 0.70::double, 0)
    when trim(upper(s[1]) || lower(s[2:])) = 'Minor' then mi when trim(upper(s[1]) || lower(s[2:])) = 'Moderate' then mo
    when trim(upper(s[1]) || lower(s[2:])) = 'Severe' then se else 0 end as bigint) as price, count(*) as n
  from (select label, case when det_seq % 6 = 0 then ' ' || severity when det_seq % 6 = 1 then upper(severity)
      else coalesce(severity, 'none') end as s from {{detections}}) d
  left join {values(CATALOG_ROWS)} c(k, mi, mo, se) on c.k = lower(trim(d.label))
  group by 1, 2, 3""")
def catalog_price(t):
    seq = F.col("det_seq")
    sev = F.when(seq % 6 == 0, F.concat(F.lit(" "), "severity")).when(seq % 6 == 1, F.upper("severity")).otherwise(
        F.coalesce("severity", F.lit("none")))
    rows = t.detections.select("label", sev.alias("severity"))
    return (rows.withColumn("price", P.catalog_price(F.col("label"), F.col("severity")))
            .groupBy("label", "severity", "price").agg(F.count(F.lit(1)).alias("n")))


# ---- risk ----------------------------------------------------------------------
PAIRS = values(sorted({p for a, b in K.PLAUSIBLE_PAIRS for p in ((a, b), (b, a))}))
RISK_LABEL = """risk_det as (select *, case when det_seq % 3 = 0 then 'Door ' else label end as risk_label from {detections})"""
SCORE_CTE = f"""{RISK_LABEL},
pairs as (select a.claim_id, count(*) as pairs, count(*) filter (where p.x is null) as implausible_pairs
  from risk_det a join risk_det b on a.claim_id = b.claim_id and a.det_seq < b.det_seq
  left join {PAIRS} p(x, y) on p.x = lower(trim(a.risk_label)) and p.y = lower(trim(b.risk_label)) group by 1),
agg as (select c.claim_id, count(d.claim_id) as n,
    count(*) filter (where severity = 'severe' and confidence < 0.6) as doubtful, round(avg(confidence), 9) as avgc
  from {{context}} c left join risk_det d using (claim_id) group by 1),
scored as (select a.claim_id, n, doubtful, coalesce(pairs, 0) as pairs, coalesce(implausible_pairs, 0) as implausible_pairs, avgc,
  case when n = 0 then 0 when n = 1 then 2 else cast(floor(implausible_pairs::double / pairs * 25 + 0.5::double) as bigint) end as consistency_score,
  case when n = 0 then 'low' when n = 2 then 'medium' else 'high' end as consistency_conf,
  least(25, doubtful * 12) as severity_score,
  case when n = 0 then 'low' when doubtful = 0 then 'high' else 'medium' end as severity_conf,
  case when n = 0 then 0 when avgc >= 0.8 then 2 when avgc >= 0.6 then 8 when avgc >= 0.4 then 16 else 22 end as confidence_score,
  case when n = 0 then 'low' when avgc >= 0.6 then 'high' else 'medium' end as confidence_conf,
  case when n = 0 then 0 when n <= 3 then 2 when n <= 6 then 8 else 20 end as count_score,
  case when n between 1 and 5 then 'high' else 'medium' end as count_conf
  from agg a left join pairs using (claim_id)),
total as (select *, consistency_score + severity_score + confidence_score + count_score as total_score from scored)"""


def weight_sql(c: str) -> str:
    return f"case {c} when 'high' then 1.0::double when 'medium' then 0.7::double else 0.4::double end"


def _risk_input(t):
    return t.detections.withColumn("label", F.when(F.col("det_seq") % 3 == 0, "Door ").otherwise(F.col("label")))


@query(f"""with {SCORE_CTE} select claim_id, total_score,
  case when total_score <= 25 then 'low' when total_score <= 55 then 'medium' else 'high' end as risk_level,
  {half_up_sql(f"((({weight_sql('consistency_conf')} + {weight_sql('severity_conf')}) + {weight_sql('confidence_conf')}) + {weight_sql('count_conf')}) / 4 * 100")} as overall_confidence
  from total""")
def risk_score(t):
    return R.risk_score(_risk_input(t), t.context).select("claim_id", "total_score", "risk_level", "overall_confidence")


@query(f"""with {SCORE_CTE}
select claim_id, 1 as layer_no, 'Damage Consistency' as layer, consistency_score as score, consistency_conf as confidence from total
union all select claim_id, 2, 'Severity vs. Cost Plausibility', severity_score, severity_conf from total
union all select claim_id, 3, 'AI Detection Confidence', confidence_score, confidence_conf from total
union all select claim_id, 4, 'Detection Count Analysis', count_score, count_conf from total""")
def risk_layers(t):
    return R.risk_layers(R.risk_score(_risk_input(t), t.context))


@query(f"with {SCORE_CTE} select claim_id, n, pairs, implausible_pairs from total where n > 0")
def label_pair_plausibility(t):
    return R.plausibility(_risk_input(t))


# ---- frames, de-duplication, severities -----------------------------------------
@query("""with s as (select claim_id, frame_index, round(sum(confidence), 9) as s from {detections} group by 1, 2),
f as (select o_orderkey as claim_id from {orders})
select f.claim_id, coalesce(arg_min(frame_index, (-s, frame_index)), 0) as best_frame,
  coalesce(max(s), 0.0::double) as confidence_sum
from f left join s using (claim_id) group by 1""")
def best_frame(t):
    frames = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.lit(0).alias("frame_index"))
    return D.best_frame(t.detections, frames)


@query("""with best as (select claim_id, label, arg_min(x1, (-confidence, det_seq)) as bx1, arg_min(y1, (-confidence, det_seq)) as by1,
    arg_min(x2, (-confidence, det_seq)) as bx2, arg_min(y2, (-confidence, det_seq)) as by2 from {detections} group by 1, 2),
p as (select d.claim_id, det_seq, greatest(0.0, least(x2, bx2) - greatest(x1, bx1)) * greatest(0.0, least(y2, by2) - greatest(y1, by1)) as i,
    (x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) as total from {detections} d join best using (claim_id, label))
select claim_id, det_seq, round(case when total - i > 0 then i / (total - i) else 0 end, 6) as iou from p""")
def box_iou_to_best(t):
    """Overlap of every detection with the most confident one of its claim and label."""
    d = t.detections
    top = F.min(F.struct((-F.col("confidence")).alias("c"), "det_seq", *D.BOX)).alias("top")
    best = d.groupBy("claim_id", "label").agg(top)
    a, b = [F.col(c) for c in D.BOX], [F.col(f"top.{c}") for c in D.BOX]
    return d.join(best, ["claim_id", "label"]).select("claim_id", d["det_seq"], F.round(box_iou(a, b), 6).alias("iou"))


KEEP_CTE = """cand as (
  select claim_id, list([{'det_seq': det_seq, 'label': label, 'ln': %s, 'confidence': confidence, 'severity': severity,
      'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'f': frame_index}] order by -confidence, det_seq) as items
  from {detections} group by 1),
walk as (select claim_id, list_reduce(items, lambda acc, x: case when len(acc) >= 12 or len(list_filter(acc, lambda k:
      k.ln = x[1].ln and case when k.f = x[1].f then (%s) >= 0.35 else (%s) >= 0.25 or
        sqrt(pow((k.x1 + k.x2) / 2 / 1280 - (x[1].x1 + x[1].x2) / 2 / 1280, 2)
          + pow((k.y1 + k.y2) / 2 / 720 - (x[1].y1 + x[1].y2) / 2 / 720, 2)) <= 0.12 end)) > 0
    then acc else list_concat(acc, x) end) as kept from cand),
kept as (select claim_id, idx - 1 as keep_idx, kept[idx].det_seq as det_seq, kept[idx].label as label,
    kept[idx].ln as label_norm, kept[idx].confidence as confidence, kept[idx].severity as severity, kept[idx].x1 as x1, kept[idx].y1 as y1,
    kept[idx].x2 as x2, kept[idx].y2 as y2
  from (select claim_id, kept, unnest(range(1, len(kept) + 1)) as idx from walk))"""
_INTER = ("(greatest(0.0::double, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * "
          "greatest(0.0::double, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1)))")
_IOU = (f"{_INTER} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_INTER})")
KEEP_CTE = KEEP_CTE % (NORM, _IOU, _IOU)


@query(f"with {KEEP_CTE} select claim_id, keep_idx, det_seq, label_norm, confidence from kept")
def dedupe_detections(t):
    return D.dedupe_detections(t.detections).select("claim_id", "keep_idx", "det_seq", "label_norm", "confidence")


@query(f"""with {KEEP_CTE} select claim_id, keep_idx, case when det_seq % 7 <> 0 then severity end as severity,
  case when det_seq % 7 <> 0 and severity is not null then 'note ' || keep_idx end as note from kept""")
def attach_severity(t):
    kept = materialize(D.dedupe_detections(t.detections))
    answered = kept.where(F.col("det_seq") % 7 != 0).select(
        "claim_id", D.detection_id(F.col("label"), F.col("keep_idx")).alias("detection_id"), "keep_idx", "severity")
    final = answered.withColumn("result_seq", F.lit(2)).withColumn("note", F.concat(F.lit("note "), "keep_idx"))
    stale = answered.withColumn("result_seq", F.lit(1)).withColumn("severity", F.lit("minor")).withColumn("note", F.lit("old"))
    priced, unanswered = D.attach_severity(kept.drop("severity"), final.unionByName(stale))
    cols = ["claim_id", "keep_idx", "severity", F.when(F.col("severity").isNotNull(), F.col("severity_note")).alias("note")]
    return priced.select(*cols).unionByName(unanswered.select(*cols))


@query("""with req as (select distinct claim_id, label || '-' || (det_seq % 5) as detection_id from {detections}),
ret as (select claim_id, label || '-' || (det_seq % 5 + case when det_seq % 17 = 0 then 9 else 0 end) as detection_id from {detections} where det_seq % 13 <> 0),
got as (select claim_id, detection_id, count(*) as times from ret group by 1, 2),
j as (select claim_id, r.detection_id as w, g.times from req r full join got g using (claim_id, detection_id))
select claim_id, count(*) filter (where times is null) as missing, count(*) filter (where w is null) as unexpected,
  count(*) filter (where times > 1) as duplicated,
  count(*) filter (where times is null) + count(*) filter (where w is null) + count(*) filter (where times > 1) = 0 as complete
from j group by 1""")
def detection_ids_complete(t):
    seq = F.col("det_seq")
    ident = lambda extra: D.detection_id(F.col("label"), seq % 5 + extra).alias("detection_id")
    returned = t.detections.where(seq % 13 != 0).select("claim_id", ident(F.when(seq % 17 == 0, 9).otherwise(0)))
    return D.ids_complete(t.detections.select("claim_id", ident(F.lit(0))), returned)


@query(f"""with {KEEP_CTE}, s as (select claim_id,
  'Detected: ' || string_agg(label || ' (' || cast(floor(confidence * 100) as bigint) || '%)', ', ' order by keep_idx) as summary,
  cast(max(floor(confidence * 100)) as bigint) as peak_pct, count(*) as areas,
  count(*) filter (where severity = 'severe') as n_severe, count(*) filter (where severity = 'minor') as n_minor
from kept group by 1)
select o_orderkey as claim_id, coalesce(summary, 'No damages detected') as summary, coalesce(peak_pct, 0) as peak_pct, coalesce(areas, 0) as areas,
  coalesce(n_severe, 0) as n_severe, coalesce(n_minor, 0) as n_minor from {{orders}} left join s on claim_id = o_orderkey""")
def detection_summary(t):
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"))
    return D.detection_summary(D.dedupe_detections(t.detections), claims).select(
        "claim_id", "summary", "peak_pct", "areas", "n_severe", "n_minor")


@query("""with r as (select claim_id, det_seq, least(1.0::double, confidence * 1.2::double) as c,
    det_seq % 3 = 0 and least(1.0::double, confidence * 1.2::double) >= 0.6 as f from {detections})
select claim_id, bool_or(f) as flagged, case when bool_or(f) then max(c) filter (where f) else max(c) end as confidence,
  case when bool_or(f) then 'seen ' || arg_min(det_seq, (-c, det_seq)) filter (where f) else '' end as evidence
from r group by 1""")
def screen_flag_rollup(t):
    seq = F.col("det_seq")
    results = t.detections.select(
        "claim_id", seq.alias("keep_idx"), (F.col("confidence") * 1.2).alias("replay_confidence"),
        F.when(seq % 3 == 0, "yes").otherwise("no").alias("replay_suspected"),
        F.array(F.concat(F.lit("seen "), seq.cast("string"))).alias("replay_evidence"))
    return D.replay_flag(results).withColumn("evidence", F.array_join("evidence", "|"))


@query(f"""with {KEEP_CTE}, {LABELS_CTE}, first as (select claim_id, label, arg_min(det_seq, keep_idx) as first_seq from kept group by 1, 2)
select claim_id, keep_idx, first_seq from kept join first using (claim_id, label)""")
def first_by_label(t):
    kept = materialize(D.dedupe_detections(t.detections))
    items = kept.select("claim_id", "label", "keep_idx", F.col("det_seq").alias("first_seq"))
    return D.first_by_label(kept, items, "keep_idx", ["first_seq"]).select("claim_id", "keep_idx", "first_seq")


@query("""select l_orderkey as request_id, min(l_suppkey % 3) = max(l_suppkey % 3) as single_source from {lineitem} group by 1""")
def single_source(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("request_id"), (F.col("l_suppkey") % 3).alias("image"))
    return D.single_source(rows, "request_id", "image")


@query("""with cand as (select claim_id, list([{'s': det_seq, 'x1': x1, 'y1': y1}] order by det_seq) as items from {detections} group by 1),
walk as (select claim_id, list_reduce(items, lambda acc, x: case when len(list_filter(acc, lambda k:
    abs(k.x1 - x[1].x1) < 300 and abs(k.y1 - x[1].y1) < 300)) > 0 then acc else list_concat(acc, x) end) as kept from cand)
select claim_id, unnest(kept).s as det_seq from walk""")
def suppress_close_boxes(t):
    return D.suppress_close_boxes(t.detections, "claim_id", "det_seq", 300.0).select("claim_id", "det_seq")
