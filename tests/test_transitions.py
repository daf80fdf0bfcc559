"""Guarded queue transitions, the bucketed table of accepted submissions, compaction of a ledger that goes on."""

import datetime as dt
import random

from pyspark.sql import functions as F

from claimspark.operators import ledger as L
from claimspark.session import new_dir
from claimspark.streaming import jobs as J
from claimspark.streaming.transitions import ALLOWED

EVENTS = "claim_id long, event_seq long, event_ts timestamp, action string"


def in_files(spark, folder, files, schema):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return J.read_table_stream(spark, folder, max_files=1)


def test_transitions_equal_a_loop(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    files = [[(rng.randint(0, 12), 100 * f + rng.randint(0, 99), start + dt.timedelta(minutes=f), rng.choice([*ALLOWED, "started", "unknown", None]))
              for _ in range(60)] for f in range(3)]
    files[0] += [(50, 1, start, "queued"), (50, 2, start, "started"), (51, 1, start, "queued"), (51, 2, start, "started"), (None, 1, start, "queued")]
    files.append([(99, 1, start + dt.timedelta(hours=9), "queued")])  # the watermark passes those in processing
    files.append([(50, 3, start + dt.timedelta(hours=9), "uploaded"), (98, 1, start + dt.timedelta(hours=9), "queued")])
    files.append([(50, 4, start + dt.timedelta(hours=9), "uploaded"), (51, 3, start + dt.timedelta(hours=9), "uploaded")])
    got = J.queue_transitions(in_files(spark, str(tmp_path / "q"), files, EVENTS)).collect()
    state, last, want = {}, {}, []
    for rows in files[:3]:
        for c, seq, _, action in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[3] or "")):
            stale = seq <= last.get(c, -1)
            to = None if stale else ALLOWED.get(action, {}).get(state.get(c))
            want.append((c, seq, action or "", state.get(c), to or state.get(c), "stale" if stale else "applied" if to else "illegal"))
            if to:
                state[c], last[c] = to, seq
    plain = lambda r: (r.claim_id, r.event_seq, r.action, r.from_state, r.to_state, r.verdict)
    early = [plain(r) for r in got if r.event_ts < start + dt.timedelta(hours=1) and r.action != "recovered"]
    assert sorted(early, key=str) == sorted(want, key=str)
    state[51] = "processing"
    stuck = {c for c, s in state.items() if s == "processing" and c != 50}
    assert stuck and {r.claim_id for r in got if r.action == "recovered"} == stuck  # 50 ended in the batch that moved its timer on
    assert [plain(r)[2:] for r in got if r.claim_id == 51 and r.event_seq == 3] == [("uploaded", "pending", "pending", "illegal")]
    assert [plain(r)[2:] for r in got if r.claim_id == 50 and r.event_seq > 2] == [("uploaded", "processing", "done", "applied"), ("uploaded", "done", "done", "illegal")]


def test_accepted_buckets(spark, tmp_path):
    rows = [[(k % 40, f"{k % 7}", 100 * f + k, f"v{f}-{k}") for k in range(60)] for f in range(2)] + [[(3, "3", 900, "again"), (777, "x", 901, "new")]]
    schema = "claim_id long, digest string, at long, value string"
    got = J.accept_once(in_files(spark, str(tmp_path / "s"), rows, schema), ["claim_id", "digest"], "at", buckets=8).collect()
    want = {}
    for c, d, at, v in sorted((r for f in rows for r in f), key=lambda r: r[2]):
        want.setdefault((c, d), (at, v))
    assert {(r.claim_id, r.digest): (r.at, r.value) for r in got} == want and len(got) == len(want)


def test_a_batch_reads_its_buckets_only(spark):
    out = new_dir(spark, "accepted")
    rows = spark.range(100).select(F.col("id").alias("claim_id")).withColumn("bucket", F.pmod(F.xxhash64("claim_id"), F.lit(8)).cast("int"))
    for batch in (0, 1):
        rows.write.partitionBy("bucket").parquet(f"{out}/batch={batch}")
    one = rows.where("claim_id = 5")
    read = J.accepted(spark, out, one.schema, J.touched_buckets(one))
    files = [r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all(f"bucket={one.first().bucket}/" in f for f in files)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()


def test_a_ledger_compacted_between_two_runs_loses_no_row(spark, tmp_path):
    rng = random.Random(6)
    schema = "request_id string, claim_id string, owner_id string, state string, updated_at long, event_id long"
    files = [[(f"r{rng.randint(0, 9)}", f"c{rng.randint(0, 1)}", "ann", rng.choice(["UPLOADING", "APPROVED_AUTHENTIC"]), rng.randint(0, 50), 100 * f + k)
              for k in range(30)] for f in range(5)]
    folder, path = str(tmp_path / "events"), None
    for f, rows in enumerate(files):
        events = in_files(spark, folder, [rows], schema)
        path = J.ledger_log(events, path)
        before = sorted(map(tuple, J.read_ledger(spark, path).collect()))
        if f in (0, 2, 3):
            assert J.compact_ledger(spark, path) == path
        after = sorted(map(tuple, J.read_ledger(spark, path).collect()))
        every = spark.createDataFrame([r for rs in files[: f + 1] for r in rs], schema)
        assert before == after == sorted(map(tuple, L.latest_transactions(every).select(J.read_ledger(spark, path).columns).collect()))
    assert J.ledger_version(spark, path)[0] == 3 and J.ledger_version(spark, path)[2] == 3
    # a batch that is still being written, and a snapshot without a manifest, are not seen
    spark.createDataFrame(files[0], schema).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/log/batch=77")
    J.ledger_rows(spark, path)[0].write.parquet(f"{path}/snapshots/9")
    assert sorted(map(tuple, J.read_ledger(spark, path).collect())) == after
