"""Claim-shaped tables derived from the given parquet tables.

Every fixture is one SQL text for both engines, or one per engine where the dialects
differ. ``{name}`` refers to a table or to another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# det_seq orders the detections of a claim by (line number, part, price) in one BIGINT.
BOTH = {
    "detections": """
select l_orderkey as claim_id,
  cast(l_linenumber as bigint) * 1000000000000000000 + l_partkey * 10000000
    + cast(round(l_extendedprice * 100) as bigint) % 10000000 as det_seq,
  case l_partkey % 9 when 0 then 'Dent' when 1 then 'scratch' when 2 then 'Crack'
    when 3 then 'Paint chip' when 4 then 'head_light damage' when 5 then 'Windshield damage'
    when 6 then 'tail-light' when 7 then 'bumper' else 'Frame damage' end as label,
  cast(30 + (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 70 as double) / 100 as confidence,
  l_linenumber % 3 as frame_index,
  cast((l_partkey * 37) % 900 as double) as x1,
  cast((l_suppkey * 53) % 500 as double) as y1,
  cast((l_partkey * 37) % 900 + 60 + l_quantity * 4 as double) as x2,
  cast((l_suppkey * 53) % 500 + 40 + l_quantity * 3 as double) as y2,
  1280 as frame_width, 720 as frame_height,
  case (l_suppkey + l_linenumber) % 8 when 0 then 'none' when 1 then 'minor'
    when 2 then 'semi_minor' when 3 then 'moderate' when 4 then 'semi_moderate'
    when 5 then 'semi_severe' when 6 then 'severe' else null end as severity
from {lineitem}""",
    "context": """
select o_orderkey as claim_id,
  case o_orderkey % 8 when 0 then 'front' when 1 then 'rear' when 2 then 'left-side'
    when 3 then 'right-side' when 4 then 'roof' when 5 then 'underbody'
    when 6 then 'multiple' else 'unspecified' end as location,
  cast(o_orderkey % 14 as int) as parts_count,
  case o_orderkey % 4 when 0 then 'localized' when 1 then 'multi-panel'
    when 2 then 'frame-level' else 'other' end as extent,
  case o_orderkey % 5 when 0 then 'unspecified' when 1 then 'Dent, scratch'
    when 2 then 'windshield;paint chip' when 3 then null else 'all' end as reported_damage_type
from {orders}""",
    "claims": """
select o_orderkey as claim_id, o_custkey as owner_id, c_name as customer_name,
  r_name as region,
  case when o_orderpriority = '1-URGENT' then 'flagged' when o_orderstatus = 'F' then 'approved'
    when o_orderstatus = 'O' then 'pending' else 'rejected' end as status,
  o_totalprice as estimated_cost, o_orderdate as submitted_at,
  o_orderkey % 10 as agent_id
from {orders} join {customer} on o_custkey = c_custkey
  join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "transactions": """
select event_id % 4000 as request_id, event_id, user_id as owner_id, event_id % 4000 as claim_id,
  case event_type when 'view' then 'UPLOADING' when 'click' then 'FORENSICS_COMPLETE'
    when 'signup' then 'INFERENCE_COMPLETE' when 'purchase' then 'APPROVED_AUTHENTIC'
    else 'REJECTED_FORENSICS' end as state,
  ts as updated_at
from {events}""",
    "stage_results": """
select o_orderkey as claim_id, stage,
  case when stage = 5 then 'SKIPPED' when (o_orderkey * 7 + stage * 11) % 23 = 0 then 'FAILED'
    when stage = 3 and o_orderkey % 29 = 0 then 'WARNING' else 'PASSED' end as raw_status,
  case stage when 1 then 'EXIF_CONTAINER_REJECTED' when 2 then 'DUPLICATE_CLAIM_REJECTED'
    when 3 then 'VISUAL_TAMPERING_REJECTED' when 4 then 'CLAIMANT_FACE_REQUIRED'
    else 'REVERSE_SEARCH_STOLEN_WEB_MEDIA' end as error_code
from {orders} cross join (select 1 as stage union all select 2 union all select 3
  union all select 4 union all select 5) s""",
    "container_text": """
select doc_id, concat(text, case doc_id % 7 when 0 then ' CapCut ' when 1 then ' edited by tool '
    when 2 then ' 2024-03-05T10:11:12Z ' when 3 then ' 2024:03:05 10:11:12 '
    when 4 then ' +19.0760+072.8777/ ' when 5 then ' whatsapp edited ' else '' end) as body
from {documents}""",
    "queue_claims": """
select event_id as claim_id, user_id as owner_id, cast(floor(value * 1000) as bigint) as size_bytes,
  event_type <> 'view' as queued, event_type = 'error' as failed, ts as last_modified,
  case event_type when 'view' then 'approved' when 'click' then 'pending_upload'
    when 'signup' then 'processing' when 'purchase' then 'rejected' else 'failed_upload' end as status
from {events}""",
    "queue_events": """
select event_id % 997 as claim_id, event_id as event_seq, ts as event_ts,
  case event_type when 'view' then 'queued' when 'click' then 'started' when 'signup' then 'uploaded'
    when 'purchase' then 'invalid' else 'failed' end as action
from {events}""",
    # Every event is a capture; signatures are dealt to them in turn, places by user.
    "scene_history": """
select e.event_id as claim_id, s.claim_id as sig, s.color_sig, e.ts as capture_ts,
  cast(19.05 + (e.user_id % 400) * 0.0005 as double) as lat, cast(72.85 + (e.user_id % 400) * 0.0007 as double) as lon
from (select *, event_id % (select max(claim_id) + 1 from {signatures}) as turn from {events}) e join {signatures} s on s.claim_id = e.turn""",
    "verify_pixels": """
select 1000000 + d.doc_id as claim_id, p.frame_index, p.y, p.x, 128 + (p.v - 128) * (cast(d.doc_id % 5 + 1 as double) / 5) as v
from (select *, doc_id % (select max(claim_id) + 1 from {pixels}) as turn from {documents}) d join {pixels} p on p.claim_id = d.turn
where length(d.text) >= 40""",
}
SPARK = {
    "verify_hashes": """
select 1000000 + d.doc_id as claim_id, h.frame_index, h.bits ^ (case d.doc_id % 6 when 0 then 0L when 1 then 4095L when 2 then 1958105773755760193L when 3 then -3284181752646120303L when 4 then 6836907801653523160L else -8158935992142067755L end) as bits
from (select *, doc_id % (select max(claim_id) + 1 from {hash_frames}) as turn from {documents}) d join {hash_frames} h on h.claim_id = d.turn""",
    "blocks": """
select claim_id, frame_index, cell div 8 as r, cell % 8 as c, std,
  case when flip then 2147483647 - base else base end as bits from (
  select event_id div 128 as claim_id, event_id div 64 % 2 as frame_index,
    event_id % 64 as cell, 10 + event_id % 11 as std, (event_id * 31) % 97 = 5 as flip,
    ((event_id div 128) * 48271 + (case when event_id % 64 = 18 and event_id div 128 % 4 = 0 then 45 else event_id % 64 end) * 69621001) % 2147483647 as base
  from {events}) b""",
    # One pass over the frames: every frame yields its own row and the planted variants.
    "match_history": """
select v.claim_id, v.frame_index, v.bits, v.dbits from {hash_frames} lateral view inline(filter(array(
  named_struct('claim_id', claim_id, 'frame_index', frame_index, 'bits', bits, 'dbits', bits),
  if(claim_id % 4 = 0, named_struct('claim_id', 500000 + claim_id, 'frame_index', frame_index, 'bits', bits, 'dbits', bits), null),
  if(claim_id % 3 = 0 and frame_index < 3, named_struct('claim_id', 600000 + claim_id, 'frame_index', frame_index,
    'bits', if(frame_index = 1, 0L, ~bits), 'dbits', ~bits), null)), x -> x is not null)) v""",
    "match_incoming": """
select v.claim_id, v.frame_index, v.bits, v.dbits from {hash_frames} lateral view inline(filter(array(
  if(claim_id % 6 = 2 and frame_index in (0, 4), null, named_struct('claim_id', 1000000 + claim_id,
    'frame_index', cast(case claim_id % 6 when 1 then 4 - frame_index when 2 then frame_index - 1 else frame_index end as int),
    'bits', bits ^ (case claim_id % 6 when 3 then 4095L when 4 then 8191L when 5 then -1L else 0L end),
    'dbits', if(claim_id % 6 = 4, bits, ~bits))),
  if(claim_id % 10 = 3, named_struct('claim_id', claim_id, 'frame_index', frame_index, 'bits', bits, 'dbits', ~bits), null),
  if(frame_index = 2 and claim_id % 7 = 0, named_struct('claim_id', 2000000 + claim_id, 'frame_index', 0, 'bits', bits, 'dbits', ~bits), null),
  if(claim_id % 5 = 0 and frame_index < 3, named_struct('claim_id', 3000000 + claim_id, 'frame_index', frame_index,
    'bits', if(frame_index < 2, 0L, ~bits), 'dbits', 5L), null),
  if(claim_id % 6 = 3 and frame_index < 4, named_struct('claim_id', 4000000 + claim_id, 'frame_index', 3 - frame_index,
    'bits', if(frame_index = 2, 0L, ~bits), 'dbits', 5L), null)), x -> x is not null)) v""",
    # Events meet as rows without signatures; a mixture is built once for each pair and kind.
    "scene_incoming": """
with e as (select event_id as claim_id, event_id % (select max(claim_id) + 1 from {signatures}) as sig, event_id % 5 as kind, ts, user_id from {events}),
p as (select a.*, b.sig as other from e a join e b on b.claim_id = case when a.claim_id > 0 then a.claim_id - 1 else 1 end),
m as (select d.sig, d.other, d.kind, zip_with(x.color_sig, y.color_sig, (x, y) -> x * w + y * (1 - w)) as color_sig
  from (select distinct sig, other, kind, case kind when 0 then 1.0D when 1 then 0.9D when 2 then 0.9D when 3 then 0.7D else 0.1D end as w from p) d
  join {signatures} x on x.claim_id = d.sig join {signatures} y on y.claim_id = d.other)
select 1000000 + p.claim_id as claim_id, p.sig, p.other, p.kind, m.color_sig,
  p.ts + make_dt_interval(0, 0, 0, (p.claim_id % 11) * 60) as capture_ts,
  cast(19.05 + (p.user_id % 400) * 0.0005 as double) + (p.claim_id % 4) * 0.0004D as lat, cast(72.85 + (p.user_id % 400) * 0.0007 as double) as lon
from p join m on m.sig = p.sig and m.other = p.other and m.kind = p.kind""",
    "hash_frames": """
select vec_id div 5 as claim_id, cast(vec_id % 5 as int) as frame_index, transform(array(struct(e, m)), s ->
  aggregate(transform(s.e, (x, i) -> if(x > s.m, shiftleft(1L, cast(i as int)), 0L)), 0L, (a, b) -> a | b))[0] as bits
from (select vec_id, e, aggregate(e, 0D, (a, b) -> a + b) / size(e) as m
      from (select vec_id, cast(embedding as array<double>) as e from {embeddings}))""",
    "incoming_hashes": """
select 1000000 + claim_id as claim_id, cast(case claim_id % 6 when 1 then 4 - frame_index when 2 then frame_index - 1
    else frame_index end as int) as frame_index, bits as base_bits,
  bits ^ (case claim_id % 6 when 3 then 4095L when 4 then 8191L when 5 then -1L else 0L end) as bits
from {hash_frames} where not (claim_id % 6 = 2 and frame_index in (0, 4))""",
    "signatures": """
select vec_id as claim_id, transform(array(struct(e, s)), r -> transform(r.e, x -> x * x / r.s))[0] as color_sig
from (select vec_id, e, aggregate(e, 0D, (a, x) -> a + x * x) as s
      from (select vec_id, cast(embedding as array<double>) as e from {embeddings}))""",
    "pixels": """
select vec_id div 5 as claim_id, cast(vec_id % 5 as int) as frame_index, cast(p div 8 as int) as y,
  cast(p % 8 as int) as x, cast(v as double) * 400 + 128 as v
from {embeddings} lateral view posexplode(embedding) t as p, v""",
}
DUCK = {
    "verify_hashes": """
select 1000000 + d.doc_id as claim_id, h.frame_index, xor(h.bits, case d.doc_id % 6 when 0 then (0)::bigint when 1 then (4095)::bigint when 2 then (1958105773755760193)::bigint when 3 then (-3284181752646120303)::bigint when 4 then (6836907801653523160)::bigint else (-8158935992142067755)::bigint end) as bits
from (select *, doc_id % (select max(claim_id) + 1 from {hash_frames}) as turn from {documents}) d join {hash_frames} h on h.claim_id = d.turn""",
    "blocks": """
select claim_id, frame_index, cell // 8 as r, cell % 8 as c, std,
  case when flip then 2147483647 - base else base end as bits from (
  select event_id // 128 as claim_id, event_id // 64 % 2 as frame_index,
    event_id % 64 as cell, 10 + event_id % 11 as std, (event_id * 31) % 97 = 5 as flip,
    ((event_id // 128) * 48271 + (case when event_id % 64 = 18 and event_id // 128 % 4 = 0 then 45 else event_id % 64 end) * 69621001) % 2147483647 as base
  from {events}) b""",
    "match_history": """
select claim_id, frame_index, bits, bits as dbits from {hash_frames}
union all select 500000 + claim_id, frame_index, bits, bits from {hash_frames} where claim_id % 4 = 0
union all select 600000 + claim_id, frame_index, case when frame_index = 1 then 0 else -1 - bits end, -1 - bits
  from {hash_frames} where claim_id % 3 = 0 and frame_index < 3""",
    "match_incoming": """
select claim_id, frame_index, bits, case when (claim_id - 1000000) % 6 = 4 then base_bits else -1 - base_bits end as dbits from {incoming_hashes}
union all select claim_id, frame_index, bits, -1 - bits from {hash_frames} where claim_id % 10 = 3
union all select 2000000 + claim_id, 0, bits, -1 - bits from {hash_frames} where frame_index = 2 and claim_id % 7 = 0
union all select 3000000 + claim_id, frame_index, case when frame_index < 2 then 0 else -1 - bits end, 5
  from {hash_frames} where claim_id % 5 = 0 and frame_index < 3
union all select 4000000 + claim_id, 3 - frame_index, case when frame_index = 2 then 0 else -1 - bits end, 5
  from {hash_frames} where claim_id % 6 = 3 and frame_index < 4""",
    "scene_incoming": """
select 1000000 + a.claim_id as claim_id, a.sig, b.sig as other, a.claim_id % 5 as kind,
  list_transform(list_zip(a.color_sig, b.color_sig), lambda z: z[1] * w + z[2] * (1 - w)) as color_sig,
  a.capture_ts + to_seconds((a.claim_id % 11) * 60) as capture_ts,
  a.lat + (a.claim_id % 4) * 0.0004::double as lat, a.lon as lon
from (select *, case claim_id % 5 when 0 then 1.0::double when 1 then 0.9::double when 2 then 0.9::double when 3 then 0.7::double else 0.1::double end as w
      from {scene_history}) a join {scene_history} b on b.claim_id = case when a.claim_id > 0 then a.claim_id - 1 else 1 end""",
    "hash_frames": """
select vec_id // 5 as claim_id, vec_id % 5 as frame_index, h.bits as bits
from (select vec_id, cast(embedding as double[]) as e, list_avg(cast(embedding as double[])) as m from {embeddings}) t,
  lateral (select cast(sum(case when t.e[i] > t.m then case when i = 64 then -9223372036854775808
      else (1::bigint << (i - 1)::int) end else 0 end) as bigint) as bits from range(1, 65) r(i)) h""",
    "incoming_hashes": """
select 1000000 + claim_id as claim_id, case claim_id % 6 when 1 then 4 - frame_index when 2 then frame_index - 1
    else frame_index end as frame_index, bits as base_bits,
  xor(bits, case claim_id % 6 when 3 then 4095::bigint when 4 then 8191::bigint when 5 then (-1)::bigint
    else 0::bigint end) as bits
from {hash_frames} where not (claim_id % 6 = 2 and frame_index in (0, 4))""",
    "signatures": """
select vec_id as claim_id, list_transform(e, lambda x: x * x / s) as color_sig
from (select vec_id, cast(embedding as double[]) as e,
        list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)) as s
      from {embeddings})""",
    "pixels": """
select vec_id // 5 as claim_id, cast(vec_id % 5 as int) as frame_index, cast((i - 1) // 8 as int) as y,
  cast((i - 1) % 8 as int) as x, cast(v as double) * 400 + 128 as v
from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from {embeddings})""",
}
_REF = re.compile(r"\{([a-z]\w*)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a fixture derived from it, as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = BOTH.get(name) or SPARK[name]
    parts = {ref: fixture(spark, sf_dir, ref) for ref in dict.fromkeys(_REF.findall(sql))}
    return spark.sql(sql, **parts)


def with_ctes(body: str) -> str:
    """SQL text for DuckDB with the fixtures that ``body`` names in ``{braces}``."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in TABLES or name in done:
            return
        sql = BOTH.get(name) or DUCK[name]
        for ref in dict.fromkeys(_REF.findall(sql)):
            need(ref)
        done[name] = _REF.sub(r"\1", sql).strip()

    for ref in dict.fromkeys(_REF.findall(body)):
        need(ref)
    body = _REF.sub(r"\1", body).strip()
    if not done:
        return body
    head = ",\n".join(f"{n} as ({sql})" for n, sql in done.items())
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
