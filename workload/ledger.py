"""Ledger, receipt, queue, metadata and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import constants as K
from claimspark.functions import crypto
from claimspark.functions import text as T
from claimspark.operators import dashboards as B
from claimspark.operators import ledger as L
from claimspark.operators import metadata as M
from claimspark.operators import queue as Q
from claimspark.sources import accounts as S

from .registry import query

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
ts_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")

LATEST_CTE = """firsts as (select request_id, arg_min(owner_id, (updated_at, event_id)) as owner_id, count(*) as all_events
  from {transactions} group by 1),
latest as (select t.request_id, t.owner_id, arg_max(state, (updated_at, event_id)) as state, min(updated_at) as created_at,
    max(updated_at) as updated_at, any_value(all_events) - count(*) as collisions
  from {transactions} t join firsts f on t.request_id = f.request_id and t.owner_id = f.owner_id group by 1, 2)"""


@query(f"""with {LATEST_CTE} select request_id, owner_id, state, {TS.format('created_at')} as created_at,
  {TS.format('updated_at')} as updated_at, collisions from latest""")
def latest_state(t):
    out = L.latest_transactions(t.transactions)
    return out.select("request_id", "owner_id", "state", ts_text("created_at").alias("created_at"),
                      ts_text("updated_at").alias("updated_at"), "collisions")


@query(f"""with {LATEST_CTE} select t.request_id, t.owner_id, count(*) as events from {{transactions}} t
  join firsts f on t.request_id = f.request_id and t.owner_id <> f.owner_id group by 1, 2""")
def request_collisions(t):
    return L.request_collisions(t.transactions).select("request_id", "owner_id", "events")


@query(f"""with {LATEST_CTE} select request_id, owner_id, state, {TS.format('created_at')} as created_at,
  {TS.format('updated_at')} as updated_at, collisions from latest""")
def upsert_transactions(t):
    """Three upserts, in two of which the events overlap in time."""
    stored = L.fold_events(t.transactions.where(F.col("event_id") % 3 == 0))
    for k in (1, 2):
        stored = L.upsert_transactions(stored, t.transactions.where(F.col("event_id") % 3 == k))
    return L.settle(stored).select("request_id", "owner_id", "state", ts_text("created_at").alias("created_at"),
                                   ts_text("updated_at").alias("updated_at"), "collisions")


@query(f"""with {LATEST_CTE} select request_id, state, {TS.format('updated_at')} as updated_at
  from latest order by latest.updated_at desc, request_id limit 50 offset 25""")
def ledger_page(t):
    return L.ledger_page(L.latest_transactions(t.transactions), 50, 25).select(
        "request_id", "state", ts_text("updated_at").alias("updated_at"))


@query("select count(distinct request_id) as total_records from {transactions}")
def ledger_count(t):
    return t.transactions.agg(F.count_distinct("request_id").alias("total_records"))


@query("""with stored as (select o_orderkey as claim_id, o_custkey as owner_id from {orders} where o_orderkey % 3 = 0)
select o_orderkey as claim_id, case when s.claim_id is null then 'NONE' when s.owner_id <> o_custkey + (o_orderkey % 2) then 'FORBIDDEN'
  else 'FOUND' end as access, case when s.owner_id = o_custkey + (o_orderkey % 2) then '{{"id":' || s.claim_id || '}}' end as response_json
from {orders} left join stored s on s.claim_id = o_orderkey""".replace("{{", "{").replace("}}", "}"))
def lookup_result(t):
    o, k = t.orders, F.col("o_orderkey")
    stored = o.where(k % 3 == 0).select(k.alias("claim_id"), F.col("o_custkey").alias("owner_id"),
                                        crypto.canonical_json(id=k).alias("response_json"))
    asked = o.select(k.alias("claim_id"), (F.col("o_custkey") + k % 2).alias("owner_id"))
    return L.lookup_results(asked, stored).select("claim_id", "access", "response_json")


@query("""with sub as (select claim_id, event_id, state from {transactions}), old as (select distinct claim_id from sub where claim_id % 5 = 0)
select claim_id, arg_min(state, event_id) as state, min(event_id) as created_at from sub where claim_id % 5 <> 0 group by 1""")
def append_result(t):
    rows = t.transactions.select("claim_id", "state", F.col("event_id").alias("created_at"))
    return L.append_results(rows.where(F.col("claim_id") % 5 == 0).distinct(), rows)


PAYLOAD = """'{"claim_id":' || (doc_id % 500) || ',"digest":"' || sha256(text) || '","note":null}'"""


@query("""with sub as (select length(text) % 500 as claim_id, doc_id,
    '{"claim_id":' || (length(text) % 500) || ',"digest":"' || sha256(text) || '","note":' || case when doc_id % 10 = 9 then '"revised"' else 'null' end || '}' as payload_json from {documents}),
first as (select claim_id, arg_min(payload_json, doc_id) as p, min(doc_id) as d from sub group by 1)
select s.claim_id, doc_id, case when doc_id = d then 'new' when payload_json = p then 'same' else 'conflict' end as verdict,
  case when payload_json = p then sha256(payload_json) end as receipt,
  case when payload_json = p then 'SHA-256-UNSIGNED-DEVELOPMENT' end as algorithm
from sub s join first using (claim_id)""")
def finalise_receipts(t):
    """Texts of one length are submissions of one claim: copies come again, others and revised ones conflict."""
    note = F.when(F.col("doc_id") % 10 == 9, "revised")
    claim = F.char_length("text") % 500
    rows = t.documents.select(claim.alias("claim_id"), "doc_id", crypto.canonical_json(
        note=note, digest=crypto.digest(F.col("text")), claim_id=claim).alias("payload_json"))
    # every other submission writes its keys in another order and with blanks
    turned = F.concat(F.lit('{"note": '), F.when(note.isNull(), "null").otherwise('"revised"'), F.lit(', "claim_id": '), F.col("claim_id").cast("string"), F.lit(", "),
                      F.regexp_extract("payload_json", r'("digest":"[0-9a-f]+")', 1), F.lit("}"))
    rows = rows.withColumn("payload_json", F.when(F.col("doc_id") % 2 == 1, turned).otherwise(F.col("payload_json")))
    done = L.finalise_receipts(None, rows, "doc_id", schema="claim_id bigint, digest string, note string")
    return done.select("claim_id", "doc_id", "verdict", "receipt", "algorithm")


def _payloads(t):
    claim = F.col("doc_id") % 500
    payload = crypto.canonical_json(note=F.lit(None).cast("string"), digest=crypto.digest(F.col("text")), claim_id=claim)
    return t.documents.select(claim.alias("claim_id"), "doc_id", payload.alias("payload_json"))


def _pad_hex(secret: bytes, byte: int) -> str:
    return "".join(f"{b ^ byte:02X}" for b in secret.ljust(64, b"\0"))


@query(f"""select doc_id, sha256(unhex('{_pad_hex(b"ledger key 7", 0x5C)}') ||
  unhex(sha256(unhex('{_pad_hex(b"ledger key 7", 0x36)}') || encode({PAYLOAD})))) as receipt,
  'HMAC-SHA256' as algorithm, 'k1' as key_id from {{documents}}""")
def signed_receipts(t):
    return _payloads(t).withColumn("r", crypto.receipt(F.col("payload_json"), b"ledger key 7", "k1")).select("doc_id", "r.*")


@query(f"select doc_id % 500 as claim_id, {PAYLOAD} as payload_json from {{documents}}")
def canonical_json(t):
    return _payloads(t).select("claim_id", "payload_json")


@query("select doc_id, sha256(text) as file_sha256 from {documents}")
def evidence_digest(t):
    return t.documents.select("doc_id", crypto.digest(F.col("text")).alias("file_sha256"))


@query("select sha256(text) as file_sha256, count(*) as copies, min(doc_id) as first_id from {documents} group by 1 having count(*) > 1")
def exact_duplicates(t):
    rows = t.documents.select("doc_id", crypto.digest(F.col("text")).alias("file_sha256"))
    return L.exact_duplicates(rows, "file_sha256", "doc_id")


@query("""with e as (select page_id, upper(sha256(case when page_id % 9 = 0 then html || 'x' else html end)) as want from {pages} where page_id % 7 <> 0),
g as (select page_id, upper(sha256(html)) as got from {pages} where page_id % 5 <> 0)
select 'page/' || page_id as path, case when want is null then 'UNLISTED' when got is null then 'MISSING'
  when want = got then 'OK' else 'MISMATCH' end as verdict from e full join g using (page_id)""")
def verify_manifest(t):
    k = F.col("page_id")
    path = F.concat(F.lit("page/"), k.cast("string")).alias("path")
    want = crypto.digest(F.when(k % 9 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    expected = t.pages.where(k % 7 != 0).select(path, F.upper(want).alias("sha256"))
    return L.verify_manifest(t.pages.where(k % 5 != 0).select(path, crypto.digest(F.col("html")).alias("sha256")), expected)


MERGE_CTE = """src as (select claim_id, frame_index, case when claim_id % 4 = 0 then 'b' else 'a' end as sha, bits from {hash_frames} where claim_id % 3 <> 0),
dst as (select claim_id, frame_index, 'a' as sha, bits from {hash_frames} where claim_id % 5 <> 0),
merged as (select claim_id, frame_index, case when d.bits is null then 'insert' when s.sha is not null and (s.sha, s.bits) is distinct from (d.sha, d.bits)
  then 'conflict' else 'keep' end as verdict from src s full join dst d using (claim_id, frame_index))"""


def _merge_sides(t):
    k = F.col("claim_id")
    body = lambda sha: ("claim_id", "frame_index", sha.alias("file_sha256"), F.lpad(F.hex("bits"), 16, "0").alias("phash"))
    frames = t.hash_frames
    return (frames.where(k % 3 != 0).select(*body(F.when(k % 4 == 0, "b").otherwise("a"))),
            frames.where(k % 5 != 0).select(*body(F.lit("a"))))


@query(f"with {MERGE_CTE} select verdict, count(*) as rows from merged group by 1")
def merge_report(t):
    return L.merge_report(*_merge_sides(t))


@query(f"with {MERGE_CTE} select claim_id, frame_index from merged where verdict = 'conflict'")
def merge_conflicts(t):
    return L.merge_fingerprints(*_merge_sides(t)).where(F.col("verdict") == "conflict").select("claim_id", "frame_index")


@query(f"with {MERGE_CTE} select claim_id, count(*) as frames from merged group by 1")
def merge_apply(t):
    return L.apply_merge(*_merge_sides(t)).groupBy("claim_id").agg(F.count(F.lit(1)).alias("frames"))


@query("select 'events' as table_name, count(*) as rows from {events} union all select 'orders', count(*) from {orders} "
       "union all select 'lineitem', count(*) from {lineitem}")
def inventory(t):
    return L.inventory({n: getattr(t, n) for n in ("events", "orders", "lineitem")})


# ---- metadata ------------------------------------------------------------------
def first_sql(text: str, words) -> str:
    return "case " + " ".join(f"when contains({text}, '{w}') then '{w}'" for w in words) + " end"


SCAN_CTE = f"""low as (select doc_id, lower(body) as b from {{container_text}}),
scan as (select doc_id, {' or '.join(f"contains(b, '{w}')" for w in K.TRANSFER_MARKERS)} as transferred,
  {first_sql('b', K.EDITING_KEYWORDS)} as keyword, {first_sql('b', K.GENERIC_EDIT_SIGNALS)} as raw_signal from low)"""


@query(f"""with {SCAN_CTE} select doc_id, transferred, keyword, case when keyword is null and not transferred then raw_signal end as signal,
  keyword is null and (transferred or raw_signal is null) as passed from scan""")
def metadata_keyword_scan(t):
    return M.container_scan(t.container_text).drop("body")


@query(r"""with f as (select doc_id, nullif(regexp_extract(body, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}', 0), '') as iso,
  nullif(regexp_extract(body, '\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}', 0), '') as colon,
  try_cast(regexp_extract(body, '([+-]\d{2,3}\.\d{3,})\s*([+-]\d{2,3}\.\d{3,})', 1) as double) as lat,
  try_cast(regexp_extract(body, '([+-]\d{2,3}\.\d{3,})\s*([+-]\d{2,3}\.\d{3,})', 2) as double) as lon from {container_text}),
g as (select *, lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as ok from f)
select doc_id, coalesce(iso, colon) as capture_text,
  strftime(coalesce(try_strptime(iso, '%Y-%m-%dT%H:%M:%S'), try_strptime(colon, '%Y:%m:%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') as capture_ts,
  case when ok then lat end as gps_lat, case when ok then lon end as gps_lon from g""")
def capture_extract(t):
    out = M.capture_metadata(t.container_text)
    return out.select("doc_id", "capture_text", F.date_format("capture_ts", "yyyy-MM-dd HH:mm:ss").alias("capture_ts"), "gps_lat", "gps_lon")


@query("""with g as (select event_id, event_id % 90 as d, event_id % 60 as m, event_id % 59 as s, event_type in ('error', 'view') as south from {events})
select event_id, round(case when event_id % 5 = 0 then null else
  (case when south then -1 else 1 end) * (d + m / 60.0::double + (s / 2.0::double) / 3600.0::double) end, 9) as degrees from g""")
def gps_dms(t):
    e = F.col("event_id")
    dms = F.when(e % 5 == 0, F.format_string("[%d, %d]", e % 90, e % 60)).otherwise(
        F.format_string("[%d, %d, %d/2]", e % 90, e % 60, e % 59))
    ref = F.when(F.col("event_type").isin("error", "view"), "S").otherwise("N")
    return t.events.select("event_id", F.round(T.gps_dms_to_decimal(dms, ref), 9).alias("degrees"))


@query(f"""with tag as (select doc_id, doc_id % 4 = 0 as moved, doc_id % 6 = 0 as no_tags,
    nullif(trim(case doc_id % 6 when 1 then substr(text, 1, 12) when 2 then 'WhatsApp ' || substr(text, 1, 5) end), '') as sw,
    case when doc_id % 6 >= 3 then lower(text) else '' end as body, case when doc_id % 6 = 4 then trim(nullif(substr(text, 1, 19), '')) end as taken from {{documents}}),
k as (select *, {first_sql('body', K.TAG_VALUE_KEYWORDS)} as kw from tag)
select doc_id, case when no_tags and moved then 'transfer_without_tags' when no_tags then 'tags_absent' when sw is not null and (moved or contains(lower(sw), 'whatsapp')) then 'transfer_software'
    when sw is not null then 'software_tag' when kw is not null then 'editing_keyword' when moved then 'transfer_clean' else 'capture_verified' end as finding,
  case when no_tags then null when sw is not null then sw when kw is not null then kw when not moved then coalesce(taken, 'Recorded') end as evidence,
  no_tags or (sw is null and kw is null) or (sw is not null and (moved or contains(lower(sw), 'whatsapp'))) as passed
from k""")
def exif_tag_rules(t):
    """Tag values are the documents' texts, whole for artist and model."""
    k, text = F.col("doc_id"), F.col("text")
    kind = k % 6
    tags = (F.when(kind == 1, F.create_map(F.lit("EXIF Software"), F.substring(text, 1, 12)))
            .when(kind == 2, F.create_map(F.lit("Image Software"), F.concat(F.lit("WhatsApp "), F.substring(text, 1, 5))))
            .when(kind == 3, F.create_map(F.lit("Image Artist"), text))
            .when(kind == 4, F.create_map(F.lit("Image DateTime"), F.substring(text, 1, 19), F.lit("Image Model"), text))
            .when(kind == 5, F.create_map(F.lit("Image Model"), text)))
    rows = t.documents.select("doc_id", tags.alias("tags"), (k % 4 == 0).alias("transferred"))
    return M.tag_rules(rows).select("doc_id", "finding", "evidence", "passed")


# ---- queue ---------------------------------------------------------------------
@query("""select owner_id, sum(size_bytes)::bigint as total_size, count(*) filter (where queued or failed) as queued_claims,
  count(*) filter (where queued and not failed) as pending_uploads, count(*) filter (where failed) as failed_uploads,
  round(sum(size_bytes) * 100.0::double / 524288000, 9) as usage_percentage from {queue_claims} group by 1""")
def storage_usage(t):
    return Q.storage_usage(t.queue_claims).withColumn("usage_percentage", F.round("usage_percentage", 9))


@query("""select owner_id, count(*) filter (where status in ('processing', 'pending_upload')) as pending,
  count(*) filter (where status = 'approved') as approved, count(*) filter (where status = 'rejected') as rejected
from {queue_claims} group by 1""")
def status_counters(t):
    return B.status_counters(t.queue_claims)


@query("""select owner_id, claim_id from (select *, row_number() over (partition by owner_id order by last_modified desc, claim_id desc) as r
  from {queue_claims}) where r <= 25""")
def evict_oldest(t):
    return Q.evict_oldest(t.queue_claims).select("owner_id", "claim_id")


@query("""with w as (select user_id as owner_id, event_id % 200 as claim_id, arg_max(event_type, (ts, event_type)) as status, max(ts) as ts from {events} group by 1, 2)
select owner_id, claim_id, status, position from (select *, row_number() over (partition by owner_id order by ts desc, claim_id desc) as position from w) where position <= 20""")
def claim_history_write(t):
    writes = t.events.select(F.col("user_id").alias("owner_id"), (F.col("event_id") % 200).alias("claim_id"),
                             F.col("ts").alias("written_at"), F.col("event_type").alias("status"))
    return Q.claim_history(writes).select("owner_id", "claim_id", "status", "position")


@query("""select distinct owner_id, claim_id, not failed as only_pending from {queue_claims} where queued or failed""")
def queue_set_operations(t):
    pending, failed = Q.queue_ids(t.queue_claims)
    only = Q.pending_not_failed(pending, failed).withColumn("only_pending", F.lit(True))
    return Q.queued_union(pending, failed).join(only, ["owner_id", "claim_id"], "left").withColumn(
        "only_pending", F.coalesce("only_pending", F.lit(False)))


@query("""select owner_id, claim_id from {queue_claims} where (queued or failed) and claim_id % 10 = 0""")
def orphan_queue_entries(t):
    pending, failed = Q.queue_ids(t.queue_claims)
    return Q.orphan_entries(Q.queued_union(pending, failed), t.queue_claims.where(F.col("claim_id") % 10 != 0))


@query("""select claim_id, case arg_max(action, (event_ts, event_seq)) when 'queued' then 'pending' when 'started' then 'processing'
    when 'uploaded' then 'done' when 'invalid' then 'rejected' else 'failed' end as queue_state,
  count(*) filter (where action = 'failed') as failures, arg_max(event_seq, (event_ts, event_seq)) as last_seq
from {queue_events} group by 1""")
def retry_queue_state(t):
    return Q.queue_state(t.queue_events)


@query("""select coalesce(nullif(case when event_id % 4 = 0 then '' else user_id::varchar end, ''), 'local-development') as owner_id,
  count(*) as n, sum(case when event_id % 3 = 0 then 0 else cast(json_extract_string(props, '$.k') as bigint) end)::bigint as k_sum from {events} group by 1""")
def read_account_table(t):
    e = F.col("event_id")
    raw = t.events.select(F.when(e % 4 == 0, "").otherwise(F.col("user_id").cast("string")).alias("owner_id"),
                          F.when(e % 3 == 0, "{broken").otherwise(F.col("props")).alias("value_json"))
    rows = S.account_rows(raw, "k BIGINT", {"k": F.lit(0)})
    return rows.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value.k").alias("k_sum"))


@query("""select event_id, event_id % 4 <> 0 as parsed, case when event_id % 4 = 0 then null when event_id % 4 = 1 then 2 else 0 end as detections,
  case when event_id % 4 = 1 then event_type end as extra, case when event_id % 4 = 1 then event_id end as odd,
  case event_id % 4 when 0 then null when 1 then 'PASSED' else 'SKIPPED' end as duplicate_check,
  case when event_id % 4 = 1 then event_id % 7 end as metric,
  case event_id % 4 when 0 then null when 1 then strftime(to_timestamp(1700000000 + event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z')
    else '2024-06-01T00:00:00.000Z' end as audit_time
from {events}""")
def parse_stored_analysis(t):
    """Fields that the library does not know come back from the record as it is written again."""
    e = F.col("event_id")
    whole = F.format_string('{"summary":"s","extra":{"type":"%s"},"detections":[{"label":"dent","confidence":0.5,"odd":%d},{"label":"crack"}],'
                            '"fiveStageSecurity":{"timestamp":%d,"stage2_phash":{"status":"PASSED","metricValue":%d}}}', "event_type", e, e + 1700000000, e % 7)
    raw = (F.when(e % 4 == 0, "{not json").when(e % 4 == 1, whole)
           .when(e % 4 == 2, '{"detections":"oops"}').otherwise('{"summary":null}'))
    out = S.parse_stored_analysis(t.events.select("event_id", raw.alias("raw")), "raw", F.lit("2024-06-01 00:00:00").cast("timestamp"))
    v = F.col("written")
    return out.withColumn("written", F.try_parse_json(F.to_json("analysis"))).select("event_id", F.col("analysis").isNotNull().alias("parsed"),
                      F.when(F.col("analysis").isNotNull(), F.size(F.variant_get(v, "$.detections", "array<variant>"))).alias("detections"),
                      F.variant_get(v, "$.extra.type", "string").alias("extra"), F.try_variant_get(v, "$.detections[0].odd", "bigint").alias("odd"),
                      F.variant_get(v, "$.fiveStageSecurity.stage2_phash.status", "string").alias("duplicate_check"),
                      F.variant_get(v, "$.fiveStageSecurity.stage2_phash.metricValue", "bigint").alias("metric"),
                      F.variant_get(v, "$.fiveStageSecurity.timestamp", "string").alias("audit_time"))


# ---- dashboards -------------------------------------------------------------------
MONTH = "date_trunc('month', submitted_at)::date"


@query(f"""select {MONTH}::varchar as period, count(*) as total, count(*) filter (where status = 'flagged') as flagged,
  count(*) filter (where status = 'rejected') as rejected from {{claims}} group by 1 order by 1 desc limit 6""")
def fraud_trend(t):
    return B.fraud_trend(t.claims).withColumn("period", F.col("period").cast("string"))


@query("""select error_code as type, count(*) as count, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percentage
from {stage_results} where raw_status = 'FAILED' group by 1""")
def fraud_patterns(t):
    return B.fraud_patterns(t.stage_results.where(F.col("raw_status") == "FAILED")).withColumn("percentage", F.round("percentage", 6))


@query("select region, count(*) as cases from {claims} where status in ('flagged', 'rejected') group by 1")
def geo_distribution(t):
    return B.geo_distribution(t.claims)


def change_sql(m: str, unit: str) -> str:
    return (f"round(case when lag(period) over (order by period) = (period - interval 1 {unit})::date and lag({m}) over (order by period) <> 0 "
            f"then ({m} - lag({m}) over (order by period)) * 100.0::double / lag({m}) over (order by period) end, 4) as {m}_change_pct")


@query(f"""with d as (select date_trunc('day', submitted_at)::date as period, count(*) as claims, count(*) filter (where status = 'flagged') as alerts,
  count(*) filter (where status <> 'pending') as processed, round(sum(case when status = 'rejected' then estimated_cost else 0 end), 2) as savings from {{claims}} group by 1)
select period::varchar as period, claims, alerts, processed, savings, {change_sql('claims', 'day')}, {change_sql('alerts', 'day')},
  {change_sql('processed', 'day')}, {change_sql('savings', 'day')} from d""")
def daily_kpis(t):
    out = B.daily_kpis(t.claims)
    return out.select(F.col("period").cast("string").alias("period"), "claims", "alerts", "processed", F.round("savings", 2).alias("savings"),
                      *[F.round(f"{m}_change_pct", 4).alias(f"{m}_change_pct") for m in ("claims", "alerts", "processed", "savings")])


@query(f"""with d as (select {MONTH} as period, count(*) filter (where status in ('flagged', 'rejected')) as fraudulent,
  sum(case when status = 'rejected' then estimated_cost else 0 end) as saved,
  count(*) filter (where status = 'rejected') * 100.0::double / nullif(count(*) filter (where status in ('flagged', 'rejected')), 0) as rate from {{claims}} group by 1)
select period::varchar as period, fraudulent, round(saved, 2) as saved, round(rate, 4) as detection_rate,
  {change_sql('fraudulent', 'month')}, {change_sql('saved', 'month')} from d""")
def monthly_fraud_kpis(t):
    out = B.monthly_fraud_kpis(t.claims)
    return out.select(F.col("period").cast("string").alias("period"), "fraudulent", F.round("saved", 2).alias("saved"),
                      F.round("detection_rate", 4).alias("detection_rate"), F.round("fraudulent_change_pct", 4).alias("fraudulent_change_pct"),
                      F.round("saved_change_pct", 4).alias("saved_change_pct"))


@query("""select count(*) filter (where status = 'pending') as pending,
  count(*) filter (where status = 'approved' and submitted_at::date = date '1998-01-10') as completed_today,
  round(sum(estimated_cost), 2) as total_amount from {claims}""")
def settlement_kpis(t):
    s = t.claims.select(F.when(F.col("status") == "pending", "processing").when(F.col("status") == "approved", "completed")
                        .otherwise("cancelled").alias("status"), F.col("submitted_at").alias("completed_at"), F.col("estimated_cost").alias("amount"))
    return B.settlement_kpis(s, F.lit("1998-01-10").cast("date")).withColumn("total_amount", F.round("total_amount", 2))


@query("""select agent_id as member, count(*) filter (where status <> 'pending') as processed,
  round(count(*) filter (where status = 'approved') * 100.0::double / nullif(count(*) filter (where status <> 'pending'), 0), 6) as approval_rate,
  round(avg(claim_id % 97) filter (where status <> 'pending'), 6) as avg_minutes, count(distinct agent_id) as members
from {claims} group by rollup (agent_id)""")
def team_performance(t):
    rows = t.claims.select(F.col("agent_id").alias("member"), "status", (F.col("claim_id") % 97).alias("minutes"))
    return B.team_performance(rows).select("member", "processed", F.round("approval_rate", 6).alias("approval_rate"),
                                           F.round("avg_minutes", 6).alias("avg_minutes"), "members")


@query("""select claim_id, status from {claims} order by submitted_at desc, claim_id limit 5""")
def recent_claims(t):
    return B.recent_claims(t.claims).select("claim_id", "status")
