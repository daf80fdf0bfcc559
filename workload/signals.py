"""Frame-signal queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from claimspark.functions import similarity as X
from claimspark.operators import signals as S

from .registry import query

TILE = "(select vec_id, cast(embedding as double[]) as e from {embeddings})"
HASH_SUM = ("cast(sum(case when {cond} then case when {i} = 0 then -9223372036854775808 else 1::bigint << (63 - {i})::int end else 0 end) as bigint)")


@query(f"""select vec_id, {HASH_SUM.format(cond='e[i + 1] > m', i='i')} as ahash from (
  select vec_id, e, list_sum(e) / 64 as m, unnest(range(64)) as i from {TILE}) group by vec_id""")
def average_hash(t):
    return t.embeddings.select("vec_id", S.average_hash(F.col("embedding").cast("array<double>")).alias("ahash"))


@query(f"""select vec_id, {HASH_SUM.format(cond='w[(i // 8) * 9 + i % 8 + 2] > w[(i // 8) * 9 + i % 8 + 1]', i='i')} as dhash from (
  select vec_id, list_concat(e, e[1:8]) as w, unnest(range(64)) as i from {TILE}) group by vec_id""")
def difference_hash(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", S.difference_hash(F.concat(e, F.slice(e, 1, 8))).alias("dhash"))


@query(f"""with k as (select u, v, u * 8 + v as i from range(8) a(u), range(8) b(v)),
c as (select claim_id, frame_index, i, sum(p.v * cos((2 * y + 1) * u * {math.pi!r} / 16) * cos((2 * x + 1) * k.v * {math.pi!r} / 16)) as c
  from {{pixels}} p cross join k group by 1, 2, 3),
m as (select claim_id, frame_index, median(c) as med from c group by 1, 2)
select claim_id, frame_index, {HASH_SUM.format(cond='c > med', i='i')} as bits from c join m using (claim_id, frame_index) group by 1, 2""")
def dct_hash(t):
    return S.dct_hash(t.pixels)


HSV = """(select claim_id, frame_index, cast(floor(abs(v) * 7) as int) % 34 as h, cast(floor(abs(v) * 3) as int) % 256 as s,
  cast(floor(abs(v)) as int) % 256 as b, cast(floor(abs(v) * 0.5) as int) % 256 as a, cast(floor(abs(v) * 11) as int) % 256 as bb from {pixels})"""


def _hsv(t):
    q = lambda k, m: (F.floor(F.abs("v") * k).cast("int") % m)
    return t.pixels.select("claim_id", "frame_index", q(7, 34).alias("h"), q(3, 256).alias("s"), q(1, 256).alias("b"),
                           q(0.5, 256).alias("a"), q(11, 256).alias("bb"))


@query(f"""with p as {HSV}, b as (select claim_id, h * 32 // 180 as bin from p union all select claim_id, 32 + s // 8 from p union all select claim_id, 64 + b // 8 from p),
n as (select claim_id, bin, count(*) as k, sum(count(*)) over (partition by claim_id) as total from b group by 1, 2)
select claim_id, bin, round(k / total::double, 9) as share from n""")
def color_signature(t):
    sig = S.color_signature(_hsv(t))
    return (sig.select("claim_id", F.posexplode("color_sig").alias("bin", "share")).where(F.col("share") > 0)
            .withColumn("share", F.round("share", 9)))


@query(f"""with p as {HSV} select claim_id, frame_index, round(avg(s), 6) as saturation, 180 - count(distinct h) as empty_hues,
  round(sqrt(pow(avg(a) - 128, 2) + pow(avg(bb) - 128, 2)), 6) as "cast",
  180 - count(distinct h) >= 150 and (sqrt(pow(avg(a) - 128, 2) + pow(avg(bb) - 128, 2)) >= 60 or avg(s) >= 230) as color_rejected from p group by 1, 2""")
def color_cast(t):
    out = S.color_cast(_hsv(t))
    return out.withColumn("saturation", F.round("saturation", 6)).withColumn("cast", F.round("cast", 6))


@query("""with d as (select claim_id, frame_index, abs(v - lag(v) over (partition by claim_id, y, x order by frame_index)) as d from {pixels}),
p as (select claim_id, frame_index, avg(d) as pd from d group by 1, 2)
select claim_id, round(avg(pd), 6) as mean_diff, coalesce(avg(pd) >= 56.0, false) as passed from p group by 1""")
def static_feed(t):
    return S.static_feed(t.pixels, 56.0).withColumn("mean_diff", F.round("mean_diff", 6))


SPECTRUM = """(select claim_id, 0 as frame_index, (frame_index * 64 + y * 8 + x) // 20 as y, (frame_index * 64 + y * 8 + x) % 20 as x,
  case when frame_index = 4 and y = 7 and x = claim_id % 8 then abs(v) * 90 else abs(v) end as magnitude, 16 as height, 20 as width from {pixels})"""


def _spectrum(pixels):
    i = F.col("frame_index") * 64 + F.col("y") * 8 + F.col("x")
    spike = (F.col("frame_index") == 4) & (F.col("y") == 7) & (F.col("x") == F.col("claim_id") % 8)
    return pixels.select("claim_id", F.lit(0).alias("frame_index"), F.floor(i / 20).cast("int").alias("y"), (i % 20).alias("x"),
                           F.when(spike, F.abs("v") * 90).otherwise(F.abs("v")).alias("magnitude"), F.lit(16).alias("height"), F.lit(20).alias("width"))


PEAK_CTE = f"""sp as {SPECTRUM}, pk as (select claim_id, frame_index, max(magnitude) / (avg(magnitude) + 1e-6) as peak_ratio from sp
  where not (y >= 4 and y < 12 and x >= 6 and x < 14) group by 1, 2),
mo as (select *, greatest(0.0, least(1.0, (peak_ratio - 25.0) / 75.0)) as moire from pk),
tr as (select user_id as claim_id, event_id % 5 as pair, event_type <> 'view' as tracked, value > 20 as inlier from {{events}}),
pr as (select claim_id, pair, count(*) as points, count(*) filter (where tracked) as good, count(*) filter (where tracked and inlier) as inl from tr group by 1, 2),
pl as (select claim_id, coalesce(avg(case when points >= 10 and good >= 10 then inl / good::double end), 0.0) as planar from pr group by 1)"""


def _tracks(t):
    return t.events.select(F.col("user_id").alias("claim_id"), (F.col("event_id") % 5).alias("pair"),
                           (F.col("event_type") != "view").alias("tracked"), (F.col("value") > 20).alias("inlier"))


def _planar(t):
    return S.planar_ratio(_tracks(t))


@query(f"with {PEAK_CTE} select claim_id, frame_index, round(peak_ratio, 6) as peak_ratio, round(moire, 6) as moire, case when moire >= 0.65 then 'WARNING' else 'PASSED' end as status from mo")
def spectral_peak_ratio(t):
    out = S.spectral_peak_ratio(_spectrum(t.pixels))
    return out.withColumn("peak_ratio", F.round("peak_ratio", 6)).withColumn("moire", F.round("moire", 6))


@query(f"with {PEAK_CTE} select claim_id, round(planar, 9) as planar, case when planar >= 0.90 then 'WARNING' else 'PASSED' end as status from pl")
def planar_ratio(t):
    return _planar(t).withColumn("planar", F.round("planar", 9))


@query(f"""with {PEAK_CTE}, j as (select claim_id, avg(moire) as moire, coalesce(any_value(planar), 0.0) as planar from mo left join pl using (claim_id) group by 1)
select claim_id, round(0.5 * moire + 0.5 * planar, 6) as screen_score, 0.5 * moire + 0.5 * planar >= 0.5 or moire >= 0.8 or planar >= 0.85 as detected from j""")
def screen_replay_score(t):
    out = S.screen_replay(S.spectral_peak_ratio(_spectrum(t.pixels)), _planar(t))
    return out.select("claim_id", F.round("screen_score", 6).alias("screen_score"), "detected")


NOISE_CTE = """nz as (select claim_id, frame_index, y, x, abs(v - 128) as v from {pixels}),
nb as (select claim_id, frame_index, stddev_pop(sd) as inconsistency, max(sd) as peak_noise from (
  select claim_id, frame_index, y // 4 as a, x // 4 as b, stddev_pop(v) as sd from nz group by 1, 2, 3, 4) group by 1, 2),
np as (select claim_id, frame_index, max(pv) as max_patch_var, max(pv) / (min(pv) + 1e-4) as noise_ratio from (
  select claim_id, frame_index, y // 2 as a, x // 2 as b, var_pop(v) as pv from nz group by 1, 2, 3, 4) group by 1, 2),
px as (select claim_id, frame_index, cast(floor(v) as int) as v, cast(floor(v) as int) + (y * 3 + x) % 7 - 3 as v90, cast(floor(v) as int) + (y + x * 5) % 11 - 5 as v75 from {pixels}),
re as (select claim_id, frame_index, avg(least(255, floor(abs(v - v90) * 255 / m))) as mean_error, stddev_pop(abs(v - v90) - abs(v - v75)) as quality_spread
  from (select *, greatest(1, max(abs(v - v90)) over (partition by claim_id, frame_index)) as m from px) group by 1, 2)"""


def _noise(pixels):
    side = F.lit(8)
    res = pixels.select("claim_id", "frame_index", "y", "x", F.abs(F.col("v") - 128).alias("v"), side.alias("height"), side.alias("width"))
    return S.noise_blocks(res, block=4, grid=4)


def _recompressed(pixels):
    base = F.floor("v").cast("int")
    shift = lambda a, m: (base + a % m - m // 2)
    return S.recompression_error(pixels.select("claim_id", "frame_index", base.alias("v"), shift(F.col("y") * 3 + F.col("x"), 7).alias("v90"),
                                                 shift(F.col("y") + F.col("x") * 5, 11).alias("v75")))


@query(f"""with {NOISE_CTE} select claim_id, frame_index, round(inconsistency, 6) as inconsistency, round(peak_noise, 6) as peak_noise,
  round(max_patch_var, 5) as max_patch_var, round(noise_ratio, 4) as noise_ratio from nb join np using (claim_id, frame_index)""")
def block_noise_stats(t):
    return _noise(t.pixels).select("claim_id", "frame_index", F.round("inconsistency", 6).alias("inconsistency"), F.round("peak_noise", 6).alias("peak_noise"),
                            F.round("max_patch_var", 5).alias("max_patch_var"), F.round("noise_ratio", 4).alias("noise_ratio"))


@query(f"with {NOISE_CTE} select claim_id, frame_index, round(mean_error, 6) as mean_error, round(quality_spread, 6) as quality_spread from re")
def recompression_error(t):
    return _recompressed(t.pixels).select("claim_id", "frame_index", F.round("mean_error", 6).alias("mean_error"), F.round("quality_spread", 6).alias("quality_spread"))


TAMPER_CTE = f"""{NOISE_CTE}, tm as (select claim_id, frame_index, {{moved}} as moved, claim_id % 17 = 0 as color, noise_ratio, max_patch_var / 50 as mpv, peak_noise * (0.7 + claim_id % 4 * 0.3) as peak,
    inconsistency * (claim_id % 5) as inc, mean_error / (1 + claim_id % 4) as err, quality_spread from nb join np using (claim_id, frame_index) join re using (claim_id, frame_index)),
ti as (select *, greatest(0.0, least(100.0, 100 - (inc * 2.2 + err * 0.4 + quality_spread * 1.2))) as integrity from tm),
tv as (select *, case when color then 'color_filter' when noise_ratio > case when moved then 75 else 45 end and mpv > 18 then 'noise_ratio'
  when not moved and (peak > 55 or (peak > 38 and integrity < 60)) then 'peak_noise' when not moved and inc > 15 then 'inconsistency'
  when err > case when moved then 65 else 40 end then 'recompression' when not moved and integrity < 55 then 'integrity' end as rule from ti)"""


def _frame_metrics(pixels):
    k = F.col("claim_id")
    return (_noise(pixels).join(_recompressed(pixels), ["claim_id", "frame_index"])
            .withColumn("color_rejected", k % 17 == 0).withColumn("max_patch_var", F.col("max_patch_var") / 50)
            .withColumn("peak_noise", F.col("peak_noise") * (F.lit(0.7) + k % 4 * 0.3)).withColumn("inconsistency", F.col("inconsistency") * (k % 5))
            .withColumn("mean_error", F.col("mean_error") / (k % 4 + 1)))


@query(f"""with {TAMPER_CTE.replace('{moved}', 'claim_id % 3 = 0')}
select claim_id, frame_index, round(integrity, 4) as integrity, rule, rule is null as passed from tv""")
def tamper_verdict(t):
    m = _frame_metrics(t.pixels).withColumn("transferred", F.col("claim_id") % 3 == 0)
    return S.tamper_verdict(m).select("claim_id", "frame_index", F.round("integrity", 4).alias("integrity"), "rule", "passed")


@query("""with i as (select * from {blocks} where r between 1 and 6 and c between 1 and 6 and std >= 15),
h as (select a.claim_id, a.frame_index, a.r * 8 + a.c as block_a, b.r * 8 + b.c as block_b, bit_count(xor(a.bits, b.bits))::bigint as distance
  from i a join i b on a.claim_id = b.claim_id and a.frame_index = b.frame_index and a.r * 8 + a.c < b.r * 8 + b.c
  where greatest(abs(a.r - b.r), abs(a.c - b.c)) >= 2 and bit_count(xor(a.bits, b.bits)) <= 2)
select * from (select *, row_number() over (partition by claim_id order by frame_index, block_a, block_b) as rn from h) where rn = 1""".replace("select * from (select *, row", "select claim_id, frame_index, block_a, block_b, distance from (select *, row"))
def copy_move_pairs(t):
    return S.copy_move(t.blocks)


@query("""with d as (select claim_id, frame_index, r, c, bit_count(xor(bits, lag(bits) over (partition by claim_id, r, c order by frame_index)))::bigint as d from {blocks}),
v as (select a.claim_id, a.frame_index, a.r as tr, a.c as tc, a.d as target_distance, avg(b.d) as neighbour_mean
  from d a join d b on a.claim_id = b.claim_id and a.frame_index = b.frame_index and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and (a.r, a.c) <> (b.r, b.c)
  where a.d is not null and a.r between 1 and 6 and a.c between 1 and 6 group by 1, 2, 3, 4, 5)
select claim_id, frame_index, tr, tc, target_distance, round(neighbour_mean, 6) as neighbour_mean from (
  select *, row_number() over (partition by claim_id order by frame_index, tr, tc) as rn from v where target_distance >= 18 and neighbour_mean <= 3.0) where rn = 1""")
def temporal_splice_blocks(t):
    return S.temporal_splice(t.blocks).withColumn("neighbour_mean", F.round("neighbour_mean", 6))


@query("""select claim_id, det_seq from (select claim_id, det_seq, x2 - x1 as w, y2 - y1 as h, frame_width, frame_height, 100 * confidence - 30 as skin from {detections})
where w between 40 and floor(frame_width * 0.9) and h between 40 and floor(frame_height * 0.9) and w / greatest(1, h) between 0.5 and 1.6 and skin >= 15""")
def face_box_filter(t):
    d = t.detections.select("claim_id", "det_seq", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
                            "frame_width", "frame_height", (F.col("confidence") * 100 - 30).alias("skin_pct"))
    return S.face_boxes(d).select("claim_id", "det_seq")


@query("""select claim_id, round(case when count(*) filter (where (y + x) % 4 <> claim_id % 4) >= 40 and claim_id % 2 = 0 then var_pop(v) filter (where (y + x) % 4 <> claim_id % 4)
  else var_pop(v) end, 4) as variance from {pixels} group by claim_id""")
def skin_texture_variance(t):
    skin = ((F.col("y") + F.col("x")) % 4 != F.col("claim_id") % 4) & (F.col("claim_id") % 2 == 0)
    out = S.skin_texture_variance(t.pixels.select("claim_id", F.col("v").alias("laplacian"), skin.alias("skin")), ["claim_id"])
    return out.withColumn("variance", F.round("variance", 4))


@query("""select claim_id, frame_index, round(sum(case when sqrt(pow(x / 8.0::double, 2) + pow(y / 8.0::double, 2)) > 0.45 then v * v else 0 end) / (sum(v * v) + 1e-9), 9) as band_ratio
from {pixels} group by 1, 2""")
def band_energy_ratio(t):
    sp = t.pixels.select("claim_id", "frame_index", F.col("y").alias("u"), F.col("x").alias("w"), F.col("v").alias("magnitude"),
                         F.lit(8).alias("height"), F.lit(8).alias("width")).withColumnRenamed("w", "v")
    return S.band_energy_ratio(sp, ["claim_id", "frame_index"]).withColumn("band_ratio", F.round("band_ratio", 9))


@query(f"""with k as (select u, v from range(8) a(u), range(8) b(v) where u + v >= 6),
c as (select claim_id, frame_index, u, k.v as w, sum(p.v * cos((2 * y + 1) * u * {math.pi!r} / 16) * cos((2 * x + 1) * k.v * {math.pi!r} / 16))
  * case when u = 0 then sqrt(0.125) else 0.5 end * case when k.v = 0 then sqrt(0.125) else 0.5 end as c from {{pixels}} p cross join k group by 1, 2, 3, 4),
e as (select claim_id, frame_index, sum(v * v) as energy from {{pixels}} group by 1, 2),
h as (select claim_id, frame_index, sum(c * c) as high from c group by 1, 2)
select claim_id, round(stddev_pop(high / (energy + 1e-9)), 7) as local_spread, count(*) as blocks from h join e using (claim_id, frame_index) group by 1""")
def local_frequency_stats(t):
    tall = t.pixels.withColumn("y", F.col("y") + F.col("frame_index") * 8)
    return S.local_frequency_stats(tall, ["claim_id"]).withColumn("local_spread", F.round("local_spread", 7))


@query("""with f as (select claim_id, case when claim_id % 10 = 0 then null else confidence * 25 * case when claim_id % 9 = 0 then 100 else 1 end end as variance, confidence / 5000 as band, confidence / 20 as loc from {detections}),
a as (select claim_id, count(variance) as faces, count(*) filter (where variance < 900) as usable, min(variance) filter (where variance < 900) as mv,
  min(band) filter (where variance < 900) as mb, max(loc) filter (where variance < 900) as ml from f group by 1),
r as (select *, case when faces = 0 then 'no_face' when usable = 0 then 'face_required' when mv < 12 then 'smooth_skin' when mb < 8e-5 and mv < 15 then 'band_suppressed'
  when ml > 0.025 and mv < 15 then 'local_discrepancy' else 'live' end as rule from a)
select claim_id, faces, usable, round(mv, 6) as min_variance, rule, rule in ('no_face', 'live') as passed from r""")
def liveness_verdict(t):
    return S.liveness_verdict(_faces(t)).withColumn("min_variance", F.round("min_variance", 6))


def _faces(t):
    k, conf = F.col("claim_id"), F.col("confidence")
    return t.detections.select("claim_id", F.when(k % 10 != 0, conf * 25 * F.when(k % 9 == 0, 100).otherwise(1)).alias("variance"),
                                (conf / 5000).alias("band_ratio"), (conf / 20).alias("local_spread"))
