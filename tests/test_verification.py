"""The verification run on claims made by hand: each fails where it was made to."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from claimspark.operators import metadata
from claimspark.plans import claims as P

PIXELS = "claim_id LONG, frame_index INT, y INT, x INT, v DOUBLE"
HASHES = "claim_id LONG, frame_index INT, phash STRING"
BLOCKS = "claim_id LONG, frame_index INT, r INT, c INT, std DOUBLE, bits LONG"
METRICS = ("claim_id LONG, frame_index INT, color_rejected BOOLEAN, noise_ratio DOUBLE, max_patch_var DOUBLE, peak_noise DOUBLE, "
           "inconsistency DOUBLE, mean_error DOUBLE, quality_spread DOUBLE")


def evidence(spark, broken):
    """Claims 1 to 10; ``broken`` names what is wrong with each."""
    rng = random.Random(4)
    ids = range(1, 11)
    word = {k: [f"{rng.getrandbits(64):016x}" for _ in range(3)] for k in ids}
    fault = lambda k: broken.get(k)
    pixels = [(k, f, y, x, 0.0 if fault(k) == "still" else 40.0 * f + x) for k in ids if fault(k) != "no frames" for f in range(3) for y in range(2) for x in range(2)]
    history = [(900, f, word[k][f]) for k in ids if fault(k) == "copy" for f in range(3)]
    spectra = [(k, 0, y, x, 1000.0 if fault(k) == "screen" and (y, x) == (0, 0) else 1.0, 32, 32) for k in ids for y in range(32) for x in range(32)]
    bits = [rng.getrandbits(62) for _ in range(64)]
    blocks = [(k, 0, i // 8, i % 8, 20.0, bits[9] if fault(k) == "copied block" and i == 36 else bits[i]) for k in ids for i in range(64)]
    metrics = [(k, 0, False, 50.0 if fault(k) == "noise" else 1.0, 20.0, 1.0, 1.0, 1.0, 1.0) for k in ids]
    faces = [(k, 1.0 if fault(k) == "face" else 50.0, 0.1, 0.01) for k in ids if k != 9]
    body = {"edited": "made by CapCut", "no body": None}
    table = spark.createDataFrame
    return P.Evidence(
        table([(k, body.get(fault(k), "camera")) for k in ids], "claim_id LONG, body STRING"), table(pixels, PIXELS),
        table([(k, f, w) for k in ids for f, w in enumerate(word[k])], HASHES), table(history, HASHES),
        table(spectra, "claim_id LONG, frame_index INT, y INT, x INT, magnitude DOUBLE, height INT, width INT"),
        table([], "claim_id LONG, pair INT, tracked BOOLEAN, inlier BOOLEAN"), table(blocks, BLOCKS), table(metrics, METRICS),
        table(faces, "claim_id LONG, variance DOUBLE, band_ratio DOUBLE, local_spread DOUBLE"))


def test_each_claim_stops_at_its_first_failing_check(spark):
    broken = {1: "no frames", 2: "edited", 3: "still", 4: "copy", 5: "screen", 6: "copied block", 7: "noise", 8: "face", 10: "no body"}
    codes = {1: (1, "FRAME_EXTRACTION_FAILED"), 2: (1, "EXIF_CONTAINER_REJECTED"), 3: (2, "STATIC_VIDEO_REJECTED"), 4: (2, "DUPLICATE_CLAIM_REJECTED"),
             5: (3, "SCREEN_RECORDING_REJECTED"), 6: (3, "LOCALIZED_TAMPERING_REJECTED"), 7: (3, "VISUAL_TAMPERING_REJECTED"),
             8: (4, "CLAIMANT_FACE_REQUIRED")}
    e = evidence(spark, broken)
    rows = P.verify_claims(e.containers, P.forensic_checks(e)).collect()
    assert len(rows) == 50
    assert {r.claim_id: (r.stage, r.error_code) for r in rows if r.status == "FAILED"} == codes
    for k in (9, 10):  # neither a face crop nor container text
        assert {r.stage: r.status for r in rows if r.claim_id == k} == {1: "PASSED", 2: "PASSED", 3: "PASSED", 4: "PASSED", 5: "SKIPPED"}
    for k, (stage, _) in codes.items():
        later = [r.status for r in rows if r.claim_id == k and r.stage > stage]
        assert set(later) <= {"SKIPPED"} and all(r.status == "PASSED" for r in rows if r.claim_id == k and r.stage < stage)


def test_no_claims(spark):
    e = evidence(spark, {})
    assert P.verify_claims(e.containers.where(F.lit(False)), P.forensic_checks(e)).count() == 0


def test_metrics_are_built_from_pixels_of_claims_that_reach_them(spark):
    e, seen = evidence(spark, {7: "noise"}), []

    def metrics(pixels):
        seen.extend(r.claim_id for r in pixels.select("claim_id").distinct().collect())
        return e.metrics.where(F.col("claim_id").isin(seen))

    alive = spark.createDataFrame([(6,), (7,)], "claim_id LONG")
    rows = lambda given: sorted(tuple(r) for r in P.forensic_checks(given)[6](alive).select("claim_id", "raw_status").collect())
    assert rows(replace(e, metrics=metrics)) == rows(e) == [(6, "PASSED"), (7, "FAILED")]
    assert sorted(seen) == [6, 7]


def test_a_text_is_lowered_once(spark):
    texts = spark.createDataFrame([(1, "shot by CapCut"), (2, "WhatsApp, edited"), (3, "EDITED"), (4, "camera"), (5, None)], "claim_id LONG, body STRING")
    out = metadata.container_scan(texts)
    assert [tuple(r) for r in out.orderBy("claim_id").drop("body").collect()] == [
        (1, False, "capcut", None, False), (2, True, None, None, True), (3, False, None, "edited", False), (4, False, None, None, True),
        (5, None, None, None, True)]
    failed = texts.repartition(2).transform(metadata.container_scan).where(~F.col("passed")).select("claim_id")
    plan = failed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
