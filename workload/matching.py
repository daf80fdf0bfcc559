"""Fingerprint, duplicate-matching and capture-proximity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import similarity as X
from claimspark.functions import text as T
from claimspark.operators import matching as M
from claimspark.session import new_dir
from claimspark.sources import fingerprints as FP

from .registry import query

HEX = "printf('%016x', {0})"


def _frames(df, dbits=True):
    cols = [F.col("claim_id"), F.col("frame_index"), X.bits_hex(F.col("bits")).alias("phash")]
    if dbits:
        cols.append(X.bits_hex(F.col("dbits")).alias("dhash"))
    return df.select(*cols)


def _sides(t, *columns):
    return M.hash_sides(_frames(t.match_incoming), _frames(t.match_history), columns or ("phash",))


SEQ_CTE = """fi as (select claim_id, row_number() over (partition by claim_id order by frame_index) - 1 as pos,
    count(*) over (partition by claim_id) as n, bits, dbits from {match_incoming}),
fh as (select claim_id, row_number() over (partition by claim_id order by frame_index) - 1 as pos,
    count(*) over (partition by claim_id) as n, bits, dbits from {match_history}),
fp as (select i.claim_id as ic, h.claim_id as hc, i.pos as ip, h.pos as hp, i.n as inn, h.n as hn,
    bit_count(xor(i.bits, h.bits)) <= 12 as near, bit_count(xor(i.dbits, h.dbits)) <= 12 as dnear
  from fi i join fh h on i.claim_id <> h.claim_id),
r1 as (select ic, min(hc) as hc from fp where ip = 0 and hp = 0 and near group by 1),
r2 as (select ic, min(hc) as hc from fp where ip = inn - 1 and hp = hn - 1 and near group by 1),
r3 as (select ic, min(hc) as hc from (select ic, hc, inn, count(distinct ip) as m from fp where near group by 1, 2, 3)
  where m >= 2 or inn = 1 group by 1),
r4 as (select ic, min(hc) as hc from (select ic, hc, greatest(count(*) filter (where near), count(*) filter (where dnear)) / least(inn, hn)::double as rate
  from fp where ip = hp group by ic, hc, inn, hn) where rate >= 0.5 group by 1),
r5 as (select ic, min(hc) as hc from (select ic, hc, count(*) filter (where near) / least(inn, hn)::double as rate
  from fp where ip = hn - 1 - hp group by ic, hc, inn, hn) where rate >= 0.6 group by 1)"""


def rule_sql(r: str) -> str:
    return f"with {SEQ_CTE} select ic as claim_id, hc as hist_claim from {r}"


@query(rule_sql("r1"))
def anchor_match(t):
    i, h = M.sequences(_frames(t.match_incoming, False), _frames(t.match_history, False))
    return M.anchor_match(i.frames, h.frames)


@query(rule_sql("r2"))
def anchor_match_last(t):
    i, h = M.sequences(_frames(t.match_incoming, False), _frames(t.match_history, False))
    return M.anchor_match(i.frames, h.frames, last=True)


@query(rule_sql("r3"))
def subset_match(t):
    return M.subset_match(*_sides(t)[0])


@query(rule_sql("r4"))
def aligned_consensus(t):
    return M.consensus_match(_sides(t, "phash", "dhash"))


@query(rule_sql("r5"))
def reversed_match(t):
    return M.reversed_match(*_sides(t)[0])


LEGACY_CTE = """legacy as (select 700000 + claim_id as claim_id, bits from {hash_frames}),
r0 as (select i.claim_id as ic, min(l.claim_id) as hc from {match_incoming} i join legacy l
  on i.claim_id <> l.claim_id and bit_count(xor(i.bits, l.bits)) <= 12 group by 1)"""


def _legacy(t):
    return t.hash_frames.select((F.col("claim_id") + 700000).alias("claim_id"), X.bits_hex(F.col("bits")).alias("phash"))


@query(f"with {LEGACY_CTE} select ic as claim_id, hc as hist_claim from r0")
def legacy_hash_match(t):
    i = M.hash_frames(_frames(t.match_incoming, False))
    bare = _legacy(t).select("claim_id", X.hash_bits(F.col("phash")).alias("bits"))
    return M.legacy_match(i, bare, M.hamming_pairs(i, bare, classes=True))


@query("""select a.bits as l_bits, b.bits as r_bits, bit_count(xor(a.bits, b.bits))::bigint as distance
from (select distinct bits from {match_incoming}) a join (select distinct bits from {match_history}) b on bit_count(xor(a.bits, b.bits)) <= 12""")
def hamming_pairs(t):
    pairs = M.hamming_pairs(t.match_incoming, t.match_history)
    return pairs.withColumn("distance", X.bit_distance(F.col("l_bits"), F.col("r_bits")))


SIM_SQL = "list_sum(list_transform(list_zip(i.color_sig, h.color_sig), lambda z: least(z[1], z[2])))"
MOVED = "case when abs(i.sig % {0} + case when i.kind = 2 then 20 else 0 end - h.sig % {0}) <= 3 then 1 else 0 end"
# Similarities of distinct signatures, then the captures that have them.
SCENE_CTE = f"""si as materialized (select * from {{scene_incoming}}), sh as materialized (select * from {{scene_history}}),
sp as materialized (select i.sig, i.other, i.kind, h.sig as hsig, {SIM_SQL} as sim, {MOVED.format(7)} + {MOVED.format(5)} >= 1 as motion_ok
  from (select sig, other, kind, any_value(color_sig) as color_sig from si group by 1, 2, 3) i
  cross join (select sig, any_value(color_sig) as color_sig from sh group by 1) h),
r6 as (select i.claim_id as ic, min(h.hc) as hc from si i join sp using (sig, other, kind) join (select sig as hsig, min(claim_id) as hc from sh group by 1) h using (hsig)
  where sim >= 0.95 or (sim >= 0.90 and motion_ok) group by 1),
it as (select claim_id, sig, other, kind, lat, lon, cast(epoch(date_trunc('second', capture_ts)) as bigint) as sec from si),
ht as (select claim_id, sig as hsig, lat as hlat, lon as hlon, cast(epoch(date_trunc('second', capture_ts)) as bigint) as hsec from sh),
near_time as (select it.*, ht.* exclude (claim_id), ht.claim_id as hc from it join ht on hsec between sec - 300 and sec + 300),
r7 as (select claim_id as ic, min(hc) as hc from near_time join sp using (sig, other, kind, hsig) where sim >= 0.75 group by 1),
near_place as (select it.*, ht.* exclude (claim_id), ht.claim_id as hc, pow(sin(radians(hlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(hlat)) * pow(sin(radians(hlon - lon) / 2), 2) as a
  from it join ht on hlat between lat - 0.00095 and lat + 0.00095),
r8 as (select claim_id as ic, min(hc) as hc from near_place join sp using (sig, other, kind, hsig)
  where 2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)) <= 100 and sim >= 0.70 group by 1)"""


def _scenes(t):
    shift = F.when(F.col("kind") == 2, 20).otherwise(0)
    motion = lambda s: F.array(*[(F.col("sig") % m + s).cast("int") for m in (7, 5)]).alias("motion_sig")
    i = t.scene_incoming.select("claim_id", "color_sig", motion(shift), "capture_ts", "lat", "lon")
    h = t.scene_history.select("claim_id", "color_sig", motion(F.lit(0)), "capture_ts", "lat", "lon")
    return i, h


@query(f"with {SCENE_CTE} select ic as claim_id, hc as hist_claim from r6")
def scene_match(t):
    return M.scene_match(*_scenes(t))


@query(f"with {SCENE_CTE} select ic as claim_id, hc as hist_claim from r7")
def time_window_match(t):
    return M.time_window_match(*_scenes(t))


@query(f"with {SCENE_CTE} select ic as claim_id, hc as hist_claim from r8")
def gps_radius_match(t):
    return M.gps_radius_match(*_scenes(t))


@query(f"""with {SEQ_CTE}, {SCENE_CTE}, {LEGACY_CTE}, every as (select ic, hc, 0 as r from r0 union all select ic, hc, 1 from r1 union all select ic, hc, 2 from r2
  union all select ic, hc, 3 from r3 union all select ic, hc, 4 from r4 union all select ic, hc, 5 from r5
  union all select ic, hc, 6 from r6 union all select ic, hc, 7 from r7 union all select ic, hc, 8 from r8)
select ic as claim_id, min(hc) as hist_claim,
  ['legacy', 'anchor_first', 'anchor_last', 'subset', 'consensus', 'reversed', 'scene', 'time_window', 'gps_radius'][arg_min(r, (hc, r)) + 1] as rule
from every group by 1""")
def first_match(t):
    matches = M.rule_matches(_frames(t.match_incoming), _frames(t.match_history), *_scenes(t), legacy=_legacy(t))
    return M.first_match(matches)


# ---- fingerprint table ----------------------------------------------------------
@query("""with f as (select claim_id, frame_index, case when frame_index = 2 and claim_id % 3 = 0 then '' else printf('%016x', bits) end as phash, bits from {hash_frames}),
s as (select claim_id, row_number() over (partition by claim_id order by frame_index) - 1 as pos, bits,
    lag(bits) over (partition by claim_id order by frame_index) as prev from f where phash <> '')
select claim_id, pos, bit_count(xor(bits, prev))::bigint as distance from s where pos > 0""")
def motion_signature(t):
    gap = (F.col("frame_index") == 2) & (F.col("claim_id") % 3 == 0)
    frames = t.hash_frames.select("claim_id", "frame_index", F.when(gap, "").otherwise(X.bits_hex(F.col("bits"))).alias("phash"))
    return FP.motion_signature(frames)


@query("""with f as (select claim_id, frame_index, bits from {hash_frames} where not (frame_index = 2 and claim_id % 3 = 0))
select claim_id, 'sha-' || claim_id as file_sha256, 'phash' as kind, row_number() over (partition by claim_id order by frame_index) - 1 as pos,
  count(*) over (partition by claim_id) as n, printf('%016x', bits) as hash, case when claim_id % 2 = 0 then '2024-01-01T00:00:00' end as capture_timestamp from f""")
def group_fingerprints(t):
    k, f = F.col("claim_id"), F.col("frame_index")
    frames = t.hash_frames.select(
        "claim_id", F.concat(F.lit("sha-"), k.cast("string")).alias("file_sha256"), "frame_index",
        F.when((f == 2) & (k % 3 == 0), "").otherwise(X.bits_hex(F.col("bits"))).alias("phash"),
        F.when((f == 1) & (k % 2 == 0), "2024-01-01T00:00:00").alias("capture_timestamp"))
    scalars = FP.claim_scalars(frames).select("claim_id", "file_sha256", "capture_timestamp")
    return FP.group_fingerprints(frames).join(scalars, "claim_id")


def _claims(t):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "bits"))), lambda s: X.bits_hex(s["bits"]))
    k = F.col("claim_id")
    return t.hash_frames.groupBy("claim_id").agg(seq.alias("phash_seq")).select(
        "claim_id", F.concat(F.lit("sha-"), k.cast("string")).alias("file_sha256"), "phash_seq",
        F.slice("phash_seq", 1, 3).alias("dhash_seq"), F.array().cast("array<string>").alias("ahash_seq"),
        F.array(F.lit(0.5), F.lit(0.5)).alias("color_sig"), F.array(F.lit(3)).alias("motion_sig"),
        F.lit(None).cast("string").alias("capture_timestamp"), F.lit(1.5).alias("gps_lat"), F.lit(None).cast("double").alias("gps_lon"))


@query("""select claim_id, frame_index, printf('%016x', bits) as phash, case when frame_index < 3 then printf('%016x', bits) end as dhash,
  case when frame_index = 0 then '[0.5,0.5]' end as color_sig, case when frame_index = 0 then 1.5::double end as gps_lat from {hash_frames}""")
def explode_fingerprint(t):
    return FP.explode_fingerprints(_claims(t)).select("claim_id", "frame_index", "phash", "dhash", "color_sig", "gps_lat")


@query("""select claim_id, count(*) as frames from {hash_frames} where claim_id % 3 <> 0 group by 1
union all select claim_id, -1 as frames from {hash_frames} where claim_id % 6 = 0 group by 1""")
def append_fingerprint(t):
    k = F.col("claim_id")
    stored = t.hash_frames.where(k % 3 == 0).select(
        "claim_id", "frame_index", F.concat(F.when(k % 2 == 0, "old-").otherwise("sha-"), k.cast("string")).alias("file_sha256"))
    fresh, bad = FP.append_fingerprints(stored, _claims(t).withColumn("arrival", F.lit(1)), "arrival")
    return fresh.groupBy("claim_id").agg(F.count(F.lit(1)).alias("frames")).unionByName(
        bad.select("claim_id", F.lit(-1).cast("bigint").alias("frames")))


@query("select claim_id, frame_index, true as has_new_columns from {hash_frames}")
def evolve_schema(t):
    out = FP.evolve_schema(t.hash_frames.select("claim_id", "frame_index"))
    return out.select("claim_id", "frame_index", (F.col("gps_lat").isNull() & F.col("dhash").isNull()).alias("has_new_columns"))


@query("""select a.vec_id, case when a.vec_id % 9 = 0 then 999 else bit_count(xor(a.bits, b.bits))::bigint end as distance
from (select claim_id * 5 + frame_index as vec_id, bits from {hash_frames}) a join (select claim_id * 5 + frame_index as vec_id, bits from {hash_frames}) b on b.vec_id = a.vec_id + 1""")
def hamming(t):
    v = t.hash_frames.select((F.col("claim_id") * 5 + F.col("frame_index")).alias("vec_id"), X.bits_hex(F.col("bits")).alias("h"))
    a = v.withColumn("h", F.when(F.col("vec_id") % 9 == 0, "zz").otherwise(F.col("h")))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return a.join(b, "vec_id").select("vec_id", X.hamming(F.col("h"), F.col("g")).alias("distance"))


@query("""select c_custkey, round(2 * 6371000.0::double * atan2(sqrt(a), sqrt(1 - a)), 3) as metres from (
  select c_custkey, pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(d - c) / 2), 2) as a
  from (select c_custkey, (c_custkey % 90)::double as a, ((c_custkey * 7) % 90)::double as b, (c_custkey % 180)::double as c, ((c_custkey * 3) % 180)::double as d from {customer}))""")
def haversine(t):
    k = F.col("c_custkey")
    d = lambda c: c.cast("double")
    return t.customer.select("c_custkey", F.round(X.haversine_m(d(k % 90), d(k % 180), d((k * 7) % 90), d((k * 3) % 180)), 3).alias("metres"))


@query("""select claim_id, round(list_sum(list_transform(list_zip(a, b), lambda z: least(z[1], z[2]))), 9) as similarity from (
  select s.claim_id, s.color_sig as a, n.color_sig as b from {signatures} s join {signatures} n on n.claim_id = s.claim_id + 1)""")
def hist_intersection(t):
    nxt = t.signatures.select((F.col("claim_id") - 1).alias("claim_id"), F.col("color_sig").alias("b"))
    return t.signatures.join(nxt, "claim_id").select("claim_id", F.round(X.hist_intersection(F.col("color_sig"), F.col("b")), 9).alias("similarity"))


@query("""select printf('%016x', bits) as phash from {hash_frames} where frame_index <> 2""")
def read_fingerprint_hashes(t):
    """Frames without a hash are stored with an empty one and skipped by the read."""
    path = new_dir(t.spark, "fingerprints")
    frames = t.hash_frames.select("claim_id", "frame_index", F.when(F.col("frame_index") == 2, "")
                                  .otherwise(X.bits_hex(F.col("bits"))).alias("phash"))
    FP.write_fingerprints(frames, path, buckets=8)
    return FP.read_hashes(t.spark, path)


@query("""select claim_id, frame_index, printf('%016x', bits) as phash, cast(null as double) as gps_lat from {hash_frames}""")
def read_fingerprints(t):
    path = new_dir(t.spark, "fingerprints")
    FP.write_fingerprints(t.hash_frames.select("claim_id", "frame_index", X.bits_hex(F.col("bits")).alias("phash")), path, buckets=8)
    return FP.read_fingerprints(t.spark, path).select("claim_id", "frame_index", "phash", "gps_lat")
