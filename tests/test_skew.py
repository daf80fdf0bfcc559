"""Skew-safe paths give the rows of the plain paths."""

import itertools
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimspark.functions import constants as K
from claimspark.functions.similarity import bits_hex
from claimspark.operators import detections as D
from claimspark.operators import matching as M
from claimspark.operators import skew
from claimspark.sources import fingerprints as FP
from workload.fixtures import fixture

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def ordered(spark):
    data = [(k, i * 3 + k) for k in range(4) for i in range(1 if k == 3 else 23)]
    return spark.createDataFrame(data, "key INT, ord INT").repartition(5)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_positions_match_row_number(ordered, width):
    w = Window.partitionBy("key")
    plain = ordered.select("key", "ord", (F.row_number().over(w.orderBy("ord")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    assert rows(skew.with_positions(ordered, ["key"], "ord", width).select("key", "ord", "pos", "n")) == rows(plain)


@pytest.mark.parametrize("width", [1, 2, 5, 4096])
def test_previous_matches_lag(ordered, width):
    pos = skew.with_positions(ordered, ["key"], "ord")
    plain = pos.withColumn("prev", F.lag("ord").over(Window.partitionBy("key").orderBy("pos")))
    got = skew.with_previous(pos, ["key"], "pos", {"ord": "prev"}, width)
    assert rows(got.select("key", "pos", "prev")) == rows(plain.select("key", "pos", "prev"))


def test_two_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (1, 7), (2, 4)], "k INT, v INT")
    assert rows(skew.two_smallest(df, ["k"], "v")) == [(1, 5, 7), (2, 4, None)]


def test_top_per_key_limits_rows_before_the_shuffle(spark):
    df = fixture(spark, SF, "queue_claims")
    plan = skew.top_per_key(df, ["owner_id"], [F.desc("last_modified")], 25)._jdf.queryExecution().toString()
    partial = plan.index("Partial", plan.index("WindowGroupLimit"))
    assert "WindowGroupLimit" in plan and partial > 0


@pytest.mark.parametrize("limit", [0, 3])
def test_large_claims_are_deduplicated_in_rounds(spark, limit):
    det = fixture(spark, SF, "detections").where(F.col("claim_id") <= 150)
    cols = ["claim_id", "keep_idx", "det_seq"]
    # One claim with many detections exercises suppression and the cap.
    merged = det.withColumn("claim_id", F.when(F.col("claim_id") % 2 == 0, 0).otherwise(F.col("claim_id")))
    merged = merged.withColumn("det_seq", F.row_number().over(Window.orderBy("det_seq", "x1", "y1", "confidence")))
    plain = D.dedupe_detections(merged, fold_limit=10**9).select(*cols)
    assert rows(D.dedupe_detections(merged, fold_limit=limit).select(*cols)) == rows(plain)
    assert plain.groupBy("claim_id").count().agg(F.max("count")).head()[0] == K.MAX_DETECTIONS


def test_large_keys_of_uncapped_suppression(spark):
    boxes = fixture(spark, SF, "detections").where("claim_id <= 40").select("claim_id", "det_seq", "x1", "y1")
    args = ("claim_id", "det_seq", 300.0)
    assert rows(D.suppress_close_boxes(boxes, *args, fold_limit=1)) == rows(D.suppress_close_boxes(boxes, *args))


# ---- Hamming join ---------------------------------------------------------------------
@pytest.mark.parametrize("bands", [2, 3, 4, 5, 7, 13])
def test_band_radii_cover_the_radius(bands):
    plan = M.band_plan(12, bands)
    assert sum(w for _, w, _ in plan) == 64 and sum(r for *_, r in plan) == 12 - bands + 1


@pytest.mark.parametrize("bands", [3, 4, 5, 7])
def test_hamming_pairs_equal_brute_force(spark, bands):
    rng = random.Random(bands)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    left = [flip(v, n) for v in base for n in (0, 5, 11, 12, 13)]
    want = sorted((signed(a), signed(b)) for a in set(left) for b in set(base) if (a ^ b).bit_count() <= 12)
    table = lambda vs: spark.createDataFrame([(signed(v),) for v in vs] + [(None,)], "bits BIGINT")
    assert rows(M.hamming_pairs(table(left), table(base), bands=bands)) == sorted(want, key=str)


def brute_rules(incoming, history):
    """Per-rule first matches from the definitions, on {claim: [bits, ...]}."""
    near = lambda a, b: (a ^ b).bit_count() <= 12
    out = set()
    for (c, a), (rule, test) in itertools.product(incoming.items(), {
            1: lambda a, h: near(a[0], h[0]), 2: lambda a, h: near(a[-1], h[-1]),
            3: lambda a, h: (m := sum(any(near(x, y) for y in h) for x in a)) >= 2 or (len(a) == 1 and m == 1),
            4: lambda a, h: sum(map(near, a, h)) / min(len(a), len(h)) >= 0.5,
            5: lambda a, h: sum(map(near, a, h[::-1])) / min(len(a), len(h)) >= 0.6}.items()):
        hits = [k for k, h in sorted(history.items()) if k != c and test(a, h)]
        if hits:
            out.add((c, rule, hits[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_hash_rules_equal_brute_force_with_shared_values(spark, seed):
    rng = random.Random(seed)
    pool = [0] * 6 + [rng.getrandbits(63) for _ in range(5)]  # one value dominates
    clip = lambda: [rng.choice(pool) ^ (rng.choice([0, 0, 0xFFF, 0x1FFF]) << 3) for _ in range(rng.randint(1, 6))]
    history = {k: clip() for k in range(25)}
    incoming = {k: clip() for k in range(100, 130)} | {k: history[k] for k in (3, 7)}
    history |= {k: list(history[k % 25]) for k in range(25, 35)}  # copies
    table = lambda side: spark.createDataFrame([(c, i, b) for c, seq in side.items() for i, b in enumerate(seq)],
                                               "claim_id BIGINT, frame_index INT, bits BIGINT").select(
        "claim_id", "frame_index", bits_hex(F.col("bits")).alias("phash"))
    got = M.hash_rule_matches(M.hash_sides(table(incoming), table(history)))
    assert rows(got) == brute_rules(incoming, history)


# ---- scenes and places --------------------------------------------------------------------
def scenes(spark, n, seed, **extra):
    rng = random.Random(seed)
    data = []
    for k in range(n):
        raw = [rng.random() ** 6 for _ in range(12)]
        data.append((k, [x / sum(raw) for x in raw]))
    return data


@pytest.mark.parametrize("similarity,keys", [(0.9, 3), (0.7, 1), (0.5, 2)])
def test_similar_pairs_equal_brute_force(spark, similarity, keys):
    data = scenes(spark, 80, 1) + [(100, [0.5, 0.5]), (101, [0.55, 0.45]), (102, [1.0])]
    left = spark.createDataFrame([(k, k, None, s) for k, s in data], "sid INT, c1 INT, c2 INT, color_sig ARRAY<DOUBLE>")
    want = sorted((a, b) for a, x in data for b, y in data if len(x) == len(y) and sum(map(min, x, y)) >= similarity)
    i, h = left.select("sid", "color_sig"), left.select("c1", "c2", "color_sig")
    got = M.similar_pairs(i, h, i, h, similarity, keys=keys)
    assert sorted(map(tuple, got.select("l_sid", "r_c1").collect())) == want
    assert M.similar_pairs(i, h.limit(0), i, h.limit(0), similarity).count() == 0


def test_scene_without_motion_and_of_other_length(spark):
    table = lambda *r: spark.createDataFrame(r, "claim_id INT, color_sig ARRAY<DOUBLE>, motion_sig ARRAY<INT>")
    i = table((1, [0.25] * 4, None), (2, [0.25] * 4, []), (3, [0.2] * 5, [1]), (4, None, None))
    h = table((10, [0.25] * 4, [5]), (11, [0.5, 0.5], None))
    assert rows(M.scene_match(i, h)) == [(1, 10), (2, 10)]


@pytest.mark.parametrize("left,right,rows", [(60, 90, 16), (16, 16, 16), (17, 16, 16), (1, 400, 16)])
def test_blocks_of_a_hot_key_meet_once(spark, left, right, rows):
    side = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit(7).alias("k")).unionByName(
        spark.range(3).select((F.col("id") + 1000).alias(name), F.col("id").cast("int").alias("k")))
    l, r = M.in_blocks(side(left, "a"), side(right, "b"), ["k"], "a", "b", rows)
    met = l.join(r, ["k", "_lb", "_rb"]).select("a", "b").collect()
    assert sorted(map(tuple, met)) == [(a, b) for a in range(left) for b in range(right)] + [(1000 + k, 1000 + k) for k in range(3)]
    if left * right > 4 * rows * rows:
        largest = l.groupBy("k", "_lb", "_rb").count().agg(F.max("count")).first()[0]
        assert largest <= 3 * rows  # hashed ids, so about rows


def test_one_default_timestamp_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(M.in_blocks, "__defaults__", (32,))
    data = [(k, s) for k, s in scenes(spark, 150, 5)]
    table = lambda first: spark.createDataFrame([(first + k, s) for k, s in data], "claim_id INT, color_sig ARRAY<DOUBLE>").select(
        "*", F.lit("1970-01-01 00:00:00").cast("timestamp").alias("capture_ts"))
    want = {}
    for a, x in data:
        hits = [1000 + b for b, y in data if sum(map(min, x, y)) >= 0.75]
        if hits:
            want[a] = min(hits)
    assert dict(rows(M.time_window_match(table(0), table(1000)))) == want and want


@pytest.mark.parametrize("cost,few", [(0, 256), (1e9, 256), (1e9, 2)])
def test_captures_that_share_histograms(spark, monkeypatch, cost, few):
    """By time first, by histograms first, and with histograms of many captures."""
    monkeypatch.setattr(M, "PAIR_COST", cost)
    monkeypatch.setattr(M, "FEW", few)
    rng, sigs = random.Random(8), [s for _, s in scenes(spark, 12, 6)]
    mixed = [[0.8 * x + 0.2 * y for x, y in zip(a, b)] for a, b in zip(sigs, sigs[1:])] + [[None] * 12, [0.0] * 12, [-0.5] + [1.5 / 11] * 11]
    pick = lambda first, n: [(first + k, rng.choice(sigs + mixed), rng.randrange(4000), rng.randrange(30) * 0.0003) for k in range(n)]
    incoming, history = pick(0, 120), pick(1000, 150)
    table = lambda data: spark.createDataFrame([(k, s, float(sec), 10.0 + lat, 20.0) for k, s, sec, lat in data], "claim_id INT, color_sig ARRAY<DOUBLE>, sec DOUBLE, lat DOUBLE, lon DOUBLE").withColumn(
        "capture_ts", F.col("sec").cast("timestamp")).withColumn("motion_sig", F.array(F.col("claim_id") % 3 * 9))
    one = lambda x, y: y if x is None else x if y is None else min(x, y)
    alike = lambda a, b, least: None not in (t := [one(x, y) for x, y in zip(a, b)]) and sum(t) >= least

    def first(near):
        hits = ((a[0], min((b[0] for b in history if near(a, b)), default=None)) for a in incoming)
        return {a: b for a, b in hits if b is not None}

    i, h = table(incoming), table(history)
    assert dict(rows(M.time_window_match(i, h))) == first(lambda a, b: abs(a[2] - b[2]) <= 300 and alike(a[1], b[1], 0.75))
    assert dict(rows(M.gps_radius_match(i, h))) == first(lambda a, b: haversine((10 + a[3], 20), (10 + b[3], 20)) <= 100 and alike(a[1], b[1], 0.70))
    whole = lambda a, b: None not in a[1] + b[1]
    assert dict(rows(M.scene_match(i, h))) == first(lambda a, b: whole(a, b) and (alike(a[1], b[1], 0.95) or alike(a[1], b[1], 0.90) and a[0] % 3 == b[0] % 3))


def test_a_histogram_is_compared_once_and_not_once_a_capture(spark):
    table = lambda first: spark.range(600).select((F.col("id") + first).alias("claim_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.5)))
                                                  .otherwise(F.array(F.lit(0.9), F.lit(0.1))).alias("color_sig"))
    left, right = M.scenes(table(0)), M.scenes(table(1000))
    assert left.values.count() == 2 and "color_sig" not in left.claims.columns
    assert M.scene_pairs(left, right, 0.7).count() == 2 and M.scene_pairs(left, right, 0.6).count() == 4


def haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    s = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def test_gps_cells_wrap_and_hold_near_the_poles(spark):
    rng, points = random.Random(3), []
    for lat, lon in [(0, 179.99999), (0, -179.9999), (60, 10), (89.9995, 50), (-89.9999, -170), (45.0005, 179.9995), (19.05, 72.85)]:
        for _ in range(25):
            dlon = rng.uniform(-1, 1) * 0.0016 / max(math.cos(math.radians(lat)), 2e-5)
            points.append((max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * 0.0012)), (lon + dlon + 540) % 360 - 180))
    table = spark.createDataFrame([(k, [1.0], *p) for k, p in enumerate(points)], "claim_id INT, color_sig ARRAY<DOUBLE>, lat DOUBLE, lon DOUBLE")
    want = []
    for a, p in enumerate(points):
        hits = [b for b, q in enumerate(points) if a != b and haversine(p, q) <= 100.0]
        if hits:
            want.append((a, hits[0]))
    assert sorted(map(tuple, M.gps_radius_match(table, table).collect())) == want


@pytest.mark.parametrize("frames", [10, 10_000])
def test_fingerprint_sequences_of_any_length(spark, frames):
    table = spark.range(frames).select(F.lit(1).alias("claim_id"), F.lit("d").alias("file_sha256"), F.col("id").cast("int").alias("frame_index"),
                                       F.when(F.col("id") == 3, "").otherwise(F.lpad(F.hex("id"), 16, "0")).alias("phash"))
    got = FP.group_fingerprints(table).orderBy("pos").collect()
    want = [k for k in range(frames) if k != 3]
    assert [(r.kind, r.pos, r.n, int(r.hash, 16)) for r in got] == [("phash", p, frames - 1, k) for p, k in enumerate(want)]
    assert FP.claim_scalars(table).head().file_sha256 == "d"
