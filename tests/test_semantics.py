"""Hand-computed cases of single operators."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from claimspark.functions import crypto
from claimspark.functions import numbers as N
from claimspark.functions import similarity as X
from claimspark.functions import text as T
from claimspark.operators import audit as A
from claimspark.operators import detections as D
from claimspark.operators import ledger as L
from claimspark.operators import metadata as M
from claimspark.operators import pricing as P
from claimspark.operators import risk as R
from claimspark.operators import signals as S
from claimspark.session import new_dir
from claimspark.sources import accounts
from claimspark.sources import fingerprints as FP
from claimspark.streaming import jobs as J

DET = "claim_id INT, det_seq BIGINT, label STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, frame_index INT, frame_width INT, frame_height INT"


def det(spark, *rows):
    return spark.createDataFrame([(1, i, l, c, *map(float, box), f, 1000, 1000) for i, (l, c, box, f) in enumerate(rows)], DET)


def value(spark, col):
    return spark.range(1).select(col.alias("v")).head()[0]


# ---- detections ------------------------------------------------------------------
def test_far_boxes_of_one_class_are_kept(spark):
    d = det(spark, ("dent", .77, (11, 23, 95, 88), 2), ("dent", .64, (610, 512, 703, 590), 7))
    assert D.dedupe_detections(d).count() == 2


def test_repeated_area_keeps_the_most_confident(spark):
    d = det(spark, ("scratch", .71, (310, 90, 450, 260), 3), ("scratch", .83, (314, 88, 452, 263), 5))
    assert [r.confidence for r in D.dedupe_detections(d).collect()] == [.83]


def test_classes_are_independent(spark):
    d = det(spark, ("dent", .66, (310, 90, 450, 260), 2), ("scratch", .65, (314, 88, 452, 263), 2))
    assert D.dedupe_detections(d).count() == 2


def test_cap_stops_at_twelve_and_ties_keep_arrival_order(spark):
    d = det(spark, *[("dent", .5, (60 * i, 0, 60 * i + 5, 5), 1) for i in range(15)])
    assert sorted(r.det_seq for r in D.dedupe_detections(d).collect()) == list(range(12))


@pytest.mark.parametrize("payload,ok", [("null", False), ("array(named_struct('bbox', array(1D, 2D)))", False), ("array()", True),
                                        ("array(named_struct('bbox', array(1D, 2D, 3D, 4D)))", True),
                                        ("array(named_struct('bbox', cast(null as array<double>)))", False)])
def test_payload_shape(spark, payload, ok):
    col = F.expr(f"cast({payload} as array<struct<bbox: array<double>>>)")
    assert value(spark, D.valid_payload(col)) is ok


@pytest.mark.parametrize("raw,want", [("accident", "dent"), ("Head-Light", "head light damage"), ("scratched dent", "scratch"),
                                      ("  rear__bumper ", "rear bumper"), (None, ""), ("turn signal", "signlight damage")])
def test_label_chain(spark, raw, want):
    assert value(spark, T.normalize_damage_label(F.lit(raw).cast("string"))) == want


def test_missing_severity_is_reported_not_guessed(spark):
    kept = spark.createDataFrame([(1, 0, "dent"), (1, 1, "dent"), (1, 2, "crack")], "claim_id INT, keep_idx INT, label STRING")
    res = spark.createDataFrame([(1, "dent-0", 1, "minor", "a"), (1, "dent-0", 2, " Severe ", "b"), (1, "dent-1", 1, "awful", "c")],
                                "claim_id INT, detection_id STRING, result_seq INT, severity STRING, note STRING")
    good, bad = D.attach_severity(kept, res)
    assert [(r.keep_idx, r.severity, r.severity_note) for r in good.collect()] == [(0, "severe", "b")]
    assert sorted(r.keep_idx for r in bad.collect()) == [1, 2]


def test_even_sampling_rounds_half_even(spark):
    assert value(spark, D.even_positions(F.lit(6), 3)) == [0, 2, 5]
    assert value(spark, D.even_positions(F.lit(1), 12)) == [0]
    assert value(spark, D.even_positions(F.lit(3), 12)) == [0, 1, 2]


# ---- pricing and risk ----------------------------------------------------------------
@pytest.mark.parametrize("label,cost", [("windshield damage", 16200), ("sidemirror damage", 4500), ("Paint trace", 3600),
                                        ("", 7200), ("gearbox", 9000), ("head light damage", 13500)])
def test_fuzzy_price(spark, label, cost):
    df = spark.createDataFrame([(label,)], "label STRING")
    assert P.with_base_cost(df).head().base_cost == cost


@pytest.mark.parametrize("label,sev,price", [("DENT ", "minor", 1500), ("dent", " minor", 0), ("dent", "semi_minor", 2300), ("dent", "semi_severe", 7000),
                                             ("roof", "none", 3000), ("Crack", "unclear", 0), ("Crack", "huge", 0), ("Puncture", "semi_moderate", 475)])
def test_catalog_price(spark, label, sev, price):
    assert value(spark, P.catalog_price(F.lit(label), F.lit(sev))) == price


def test_estimate_golden(spark):
    d = spark.createDataFrame([(1, "dent", "severe"), (1, "scratch", None), (1, "hood", "none")], "claim_id INT, label STRING, severity STRING")
    ctx = spark.createDataFrame([(1, "front", "multi-panel", 3), (2, "roof", "other", 0)], "claim_id INT, location STRING, extent STRING, parts_count INT")
    one, two = P.repair_estimate(d, ctx).orderBy("claim_id").collect()
    # 1.25 * 1.1 * 1.16 = 1.595, half up on 159.5 gives 1.6
    # parts 7200 * 1.8 * 1.6 = 20736 and 2700 * 1.6 = 4320; labour 3110 and 648; GST 18% of 28814
    assert (one.context_multiplier, one["items"], one.parts_cost, one.labour_cost) == (1.6, 2, 25056, 3758)
    assert (one.gst, one.total_cost) == (5187, 34001)
    assert (two.total_cost, two.context_multiplier) == (0, 1.15)


def test_risk_golden(spark):
    d = spark.createDataFrame([(1, "dent", .9, "severe"), (1, "scratch", .5, "severe"), (1, "dent", .7, None), (2, "door", .3, "minor")],
                              "claim_id INT, label STRING, confidence DOUBLE, severity STRING")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "claim_id INT")
    a, b, c = R.risk_score(d, ids).orderBy("claim_id").collect()
    # pairs: dent-scratch ok, dent-dent implausible, scratch-dent ok -> round(25/3) = 8
    assert (a.consistency_score, a.severity_score, a.confidence_score, a.count_score, a.total_score, a.risk_level) == (8, 12, 8, 2, 30, "medium")
    assert (b.total_score, b.overall_confidence) == (2 + 0 + 22 + 2, 93)
    assert (c.total_score, c.risk_level, c.overall_confidence) == (0, "low", 48)


def test_rounding(spark):
    assert value(spark, N.half_up(F.lit(2.5))) == 3 and value(spark, N.half_up(F.lit(-2.5))) == -2
    assert value(spark, N.half_even(F.lit(2.5))) == 2


# ---- text ----------------------------------------------------------------------------
def test_hashes_beyond_the_signed_range(spark):
    assert value(spark, X.hamming(F.lit("ffffffffffffffff"), F.lit("0" * 16))) == 64
    assert value(spark, X.hamming(F.lit("xyz"), F.lit("0" * 16))) == 999
    assert value(spark, X.bits_hex(X.hash_bits(F.lit("80000000000000fF")))) == "80000000000000ff"


@pytest.mark.parametrize("text,ref,want", [("[48, 51, 59/2]", "N", 48 + 51 / 60 + 29.5 / 3600), ("[48, 51, 29.45]", "S", -(48 + 51 / 60 + 29 / 3600)), ("[1, 2]", "N", None)])
def test_gps_text(spark, text, ref, want):
    got = value(spark, T.gps_dms_to_decimal(F.lit(text), F.lit(ref)))
    assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("body,lat", [("x +19.0760+072.8777/", 19.076), ("+95.123-010.000", None), ("+00.000+000.000", None), ("none", None)])
def test_iso6709(spark, body, lat):
    got = value(spark, T.extract_iso6709(F.lit(body)))
    assert (got.lat if got else None) == lat


def test_keyword_order_and_transfer(spark):
    df = spark.createDataFrame([("a photoshop then CapCut",), ("exported by tool",), ("WhatsApp edited",), ("plain",)], "body STRING")
    got = [(r.keyword, r.signal, r.passed) for r in M.container_scan(df).collect()]
    assert got == [("capcut", None, False), (None, "exported by", False), (None, None, True), (None, None, True)]


def test_scan_reads_the_whole_text(spark):
    df = spark.createDataFrame([("x" * 500_000 + "capcut" + "y" * 500_000,)], "body STRING")
    assert M.container_scan(df).head().keyword == "capcut"


# ---- ledger ------------------------------------------------------------------------------
def test_receipts_are_idempotent_and_conflicts_are_reported(spark):
    rows = spark.createDataFrame([("c", 1, '{"total":7,"who":"x"}'), ("c", 2, '{"total":7,"who":"x"}'), ("c", 3, '{"total":8}')], "claim_id STRING, arrival INT, payload_json STRING")
    first = L.finalise_receipts(None, rows, "arrival", b"secret", "k").orderBy("arrival").collect()
    want = hmac.new(b"secret", rows.head().payload_json.encode(), hashlib.sha256).hexdigest()
    assert [(r.verdict, r.receipt) for r in first] == [("new", want), ("same", want), ("conflict", None)]
    stored = spark.createDataFrame([("c", '{"total":7,"who":"x"}', "old", "SHA-256-UNSIGNED-DEVELOPMENT", None)], "claim_id STRING, payload_json STRING, receipt STRING, algorithm STRING, key_id STRING")
    again = L.finalise_receipts(stored, rows.where("arrival < 3"), "arrival", b"other").collect()
    assert {(r.verdict, r.receipt) for r in again} == {("same", "old")}


def test_first_writer_has_one_new_row_whatever_the_ties(spark):
    rows = spark.createDataFrame([("c", 1, "b"), ("c", 1, "a"), ("c", 1, "a"), ("c", 2, "b"), ("d", 5, "x")], "k STRING, o INT, p STRING")
    got = sorted((r.k, r.o, r.p, r.verdict) for r in L.first_writer(rows, None, "k", "p", "o").collect())
    assert got == [("c", 1, "a", "new"), ("c", 1, "a", "same"), ("c", 1, "b", "conflict"), ("c", 2, "b", "conflict"), ("d", 5, "x", "new")]


def test_upserts_keep_collisions_and_ties(spark):
    ev = spark.createDataFrame([("r", "c", "o", "A", 1, 0), ("r", "c", "thief", "B", 5, 1), ("r", "c", "o", "C", 1, 2), ("r", "c", "thief", "D", 6, 3)],
                               "request_id STRING, claim_id STRING, owner_id STRING, state STRING, updated_at INT, event_id INT")
    stored = L.fold_events(ev.where("event_id = 1"))
    for k in (3, 0, 2):
        stored = L.upsert_transactions(stored, ev.where(f"event_id = {k}"))
    assert L.settle(stored).collect() == L.latest_transactions(ev).collect() and L.settle(stored).head().collisions == 2


def test_canonical_json_sorts_keys_and_keeps_nulls(spark):
    got = value(spark, crypto.canonical_json(b=F.lit(2), a=F.array(F.lit(1), F.lit(2)), c=F.lit(None).cast("string")))
    assert got == '{"a":[1,2],"b":2,"c":null}'


def test_nested_payloads_in_two_key_orders_have_one_receipt(spark):
    schema = "a array<struct<y int, x int>>, b struct<d string, c map<string, int>>"
    texts = ['{"b":{"d":"q","c":{"n":2,"m":1}},"a":[{"y":1,"x":2}]}', '{"a": [{"x": 2, "y": 1}], "b": {"c": {"m": 1, "n": 2}, "d": "q"}}', "not json"]
    rows = spark.createDataFrame([("c", k, t) for k, t in enumerate(texts)], "claim_id STRING, arrival INT, payload_json STRING")
    got = L.finalise_receipts(None, rows, "arrival", schema=schema).orderBy("arrival").collect()
    assert [r.verdict for r in got] == ["new", "same", "conflict"] and got[0].receipt == got[1].receipt
    assert got[0].payload_json == '{"a":[{"x":2,"y":1}],"b":{"c":{"m":1,"n":2},"d":"q"}}'


def test_long_hmac_keys(spark):
    key = b"k" * 100
    assert value(spark, crypto.hmac_sha256(key, F.lit("m"))) == hmac.new(key, b"m", hashlib.sha256).hexdigest()


def test_ledger_keeps_state_and_ignores_foreign_owner(spark):
    ev = spark.createDataFrame([("r", "c-17", "ann", "FORENSICS_COMPLETE", 1, 1), ("r", "c-17", "bob", "APPROVED_AUTHENTIC", 5, 2)],
                               "request_id STRING, claim_id STRING, owner_id STRING, state STRING, updated_at INT, event_id INT")
    row = L.latest_transactions(ev).head()
    assert (row.state, row.owner_id, row.collisions) == ("FORENSICS_COMPLETE", "ann", 1)


def test_rows_outside_the_state_domain_are_set_apart(spark):
    ev = spark.createDataFrame([("a", "UPLOADING"), ("b", "uploading"), ("c", None), ("d", "NO_DAMAGE")], "request_id STRING, state STRING")
    good, bad = L.split_domain(ev)
    assert sorted(r.request_id for r in good.collect()) == ["a", "d"] and sorted(r.request_id for r in bad.collect()) == ["b", "c"]


def test_page_bounds(spark):
    ledger = spark.range(300).select(F.col("id").alias("request_id"), F.col("id").alias("updated_at"))
    assert L.ledger_page(ledger, 500, -3).count() == 100
    assert [r.request_id for r in L.ledger_page(ledger, 0, 2).collect()] == [297]


def test_audit_stops_at_the_first_failure(spark):
    checks = spark.createDataFrame([(1, 1, 1, "PASSED", None), (1, 2, 1, "PASSED", None), (1, 3, 1, "PASSED", "x"), (1, 3, 2, "FAILED", "SCREEN_RECORDING_REJECTED"), (1, 4, 1, "PASSED", None)],
                                   "claim_id INT, stage INT, check_no INT, raw_status STRING, error_code STRING")
    got = A.audit_rollup(checks).orderBy("stage").collect()
    assert [r.status for r in got] == ["PASSED", "PASSED", "FAILED", "SKIPPED", "SKIPPED"]
    assert {r.overall for r in got} == {"FAILED"} and got[2].error_code == "SCREEN_RECORDING_REJECTED"
    assert A.audit_badge(A.audit_rollup(checks)).head().badge == "Security Failure"


def test_stored_analysis(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    raws = ['{"detections": "oops", "fiveStageSecurity": {"stages": [{"stage": 1, "status": "PASSED"}]}}', "{bad", "[]", None, "7",
            '{"mine": {"deep": [1, {"x": null}]}, "detections": [{"label": "dent", "odd": true}], "modelReasoning": [1, "b"], "fiveStageSecurity": '
            '{"overallStatus": "", "schemaVersion": "3", "timestamp": "1700000000", "stage3_ela": {"stage": 0, "name": false, "metricLabel": "m", "metricValue": [1]}}}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k INT, raw STRING")
    rows = {r.k: r.analysis and r.analysis.toPython() for r in accounts.parse_stored_analysis(df, "raw", now).collect()}
    assert rows[0]["detections"] == [] and rows[0]["fiveStageSecurity"]["stage1_exif"]["status"] == "PASSED"
    assert rows[1] is rows[2] is rows[3] is rows[4] is None
    assert rows[0]["fiveStageSecurity"]["timestamp"] == "2024-05-01T12:00:00.000Z"
    last, audit = rows[5], rows[5]["fiveStageSecurity"]
    assert last["mine"] == {"deep": [1, {"x": None}]} and last["detections"] == [{"label": "dent", "odd": True}] and last["modelReasoning"] == ["1", "b"]
    assert last["damageAreas"] == last["detection_frames"] == []
    assert (audit["overallStatus"], audit["schemaVersion"], audit["timestamp"]) == ("FAILED", 3, "1700000000")
    assert audit["stage3_ela"] == {"stage": 3, "name": "Layer 3: Visual tampering", "shortName": "Visual tampering", "status": "SKIPPED",
                                   "details": "No result is available for this check.", "metricLabel": "m", "metricValue": [1]}
    assert "metricLabel" not in audit["stage4_deepfake"]


# ---- signals -----------------------------------------------------------------------------
def test_average_hash_bit_order(spark):
    tile = [1.0] + [0.0] * 63
    assert value(spark, X.bits_hex(S.average_hash(F.array(*[F.lit(v) for v in tile])))) == "8000000000000000"


def test_frozen_feed_and_single_frame_fail(spark):
    px = spark.createDataFrame([(1, 0, 0, 0, 5.0), (1, 1, 0, 0, 5.5), (2, 0, 0, 0, 1.0), (3, 0, 0, 0, 0.0), (3, 1, 0, 0, 9.0)], "claim_id INT, frame_index INT, y INT, x INT, v DOUBLE")
    assert {r.claim_id: r.passed for r in S.static_feed(px).collect()} == {1: False, 2: False, 3: True}


# ---- sources and streams --------------------------------------------------------------------
def test_fingerprint_table_round_trip_and_pushdown(spark):
    path = new_dir(spark, "fp")
    claims = spark.createDataFrame([("a", "d1", ["00" * 8, "", "ff" * 8], [], [], [0.5, 0.5], [3], "2024-01-01T00:00:00", 1.0, 2.0)],
                                   "claim_id STRING, file_sha256 STRING, phash_seq ARRAY<STRING>, dhash_seq ARRAY<STRING>, ahash_seq ARRAY<STRING>, color_sig ARRAY<DOUBLE>, motion_sig ARRAY<INT>, capture_timestamp STRING, gps_lat DOUBLE, gps_lon DOUBLE")
    FP.write_fingerprints(FP.explode_fingerprints(claims), path)
    back = FP.group_fingerprints(FP.read_fingerprints(spark, path)).orderBy("pos").collect()
    assert [(r.kind, r.hash, r.n) for r in back] == [("phash", "00" * 8, 2), ("phash", "ff" * 8, 2)]
    scalars = FP.claim_scalars(FP.read_fingerprints(spark, path)).head()
    assert scalars.capture_timestamp == "2024-01-01T00:00:00" and scalars.color_sig == "[0.5,0.5]" and scalars.gps_lon == 2.0
    hashes = FP.read_hashes(spark, path)
    assert hashes.count() == 2
    plan = hashes._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(phash)" in plan and "ReadSchema: struct<phash:string>" in plan


def test_file_digests_and_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    files = J.digest_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    want = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest().upper()), ("b.bin", "00"), ("c.bin", "11")], "path STRING, sha256 STRING")
    assert {r.path: r.verdict for r in L.verify_manifest(files, want).collect()} == {"a.bin": "OK", "b.bin": "MISMATCH", "c.bin": "MISSING"}
    streamed = J.run_append(J.evidence_files(spark, str(tmp_path)), "files")
    assert {r.sha256 for r in streamed.collect()} == {hashlib.sha256(x).hexdigest() for x in (b"one", b"two")}


def test_streams_over_many_batches_equal_the_batch_result(spark):
    from workload.fixtures import fixture

    sf = "/root/testdata/sf0.001"
    path = new_dir(spark, "events")
    fixture(spark, sf, "events").repartition(6).write.parquet(path)
    stream = lambda: J.read_table_stream(spark, path, max_files=2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    tx = fixture(spark, sf, "transactions")
    from workload.fixtures import BOTH
    live = spark.sql(BOTH["transactions"], events=stream())
    assert rows(J.read_ledger(spark, J.ledger_log(live))) == rows(L.latest_transactions(tx))
    from claimspark.operators.queue import queue_state
    events = spark.sql(BOTH["queue_events"], events=stream()).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    want = queue_state(fixture(spark, sf, "queue_events"))
    got = J.retry_queue_table(events).select(*want.columns)
    assert rows(got) == rows(want)
