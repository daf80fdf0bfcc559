"""The persistent match index: batches appended one by one answer as the whole history does."""

import random

from pyspark.sql import functions as F

from claimspark.operators import matching as M
from claimspark.sources.match_index import MatchIndex
from tests.test_match_classes import brute, clips, table

KINDS = ["dark", "bright", "dim", "black", "hot", "some", "none"] + ["own"] * 6


def answers(index, frames):
    return sorted(tuple(r) for r in index.rule_matches(frames).select("claim_id", "rule_no", "hist_claim").collect())


def test_three_batches_equal_the_whole_history(spark, tmp_path):
    rng = random.Random(11)
    incoming = clips(rng, 40, 40, KINDS)
    parts = [clips(rng, 100 * k, 40, KINDS) for k in (2, 0, 1)]
    parts[2] |= {150 + k: list(c) for k, c in enumerate(list(incoming.values())[:8] + list(parts[0].values())[:4])}
    index, history = MatchIndex(spark, str(tmp_path / "index"), buckets=4), {}
    for k, part in enumerate(parts):
        index.append(table(spark, part))
        history |= part
        assert k == 1 or answers(index, table(spark, incoming)) == brute(incoming, history)
    rows = {name: index.table(name).count() for name in ("bands", "frames", "contents")}
    index.append(table(spark, parts[1]))  # a replayed batch
    assert rows == {name: index.table(name).count() for name in rows}
    assert answers(MatchIndex(spark, str(tmp_path / "index"), buckets=4), table(spark, incoming)) == brute(incoming, history)
    assert answers(MatchIndex(spark, str(tmp_path / "none"), buckets=4), table(spark, incoming)) == []


def test_a_batch_that_failed_midway_is_appended_again(spark, tmp_path):
    rng = random.Random(12)
    incoming, history = clips(rng, 40, 25, KINDS), clips(rng, 0, 40, KINDS)
    index = MatchIndex(spark, str(tmp_path / "index"), buckets=4)
    add, done = index._add, []

    def fails(name, rows):
        if name == "mask_claims":
            raise RuntimeError("lost")
        done.append(name)
        add(name, rows)

    index._add = fails
    try:
        index.append(table(spark, history))
    except RuntimeError:
        pass
    index._add = add
    assert "frames" in done and index.table("contents").count() == 0
    index.append(table(spark, history))
    assert answers(index, table(spark, incoming)) == brute(incoming, history)


def test_only_probes_move(spark, tmp_path):
    rng = random.Random(13)
    index = MatchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.append(table(spark, clips(rng, 0, 30, KINDS)))
    index.append(table(spark, clips(rng, 100, 30, KINDS)))
    fresh = M.prepare(M.hash_frames(table(spark, clips(rng, 200, 5, KINDS)), side="incoming"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        pairs = index.pairs(fresh)
        for df, files in ((pairs, "/bands"), (index.touched(pairs), "/frames")):
            plan = df._jdf.queryExecution().executedPlan()
            print(plan.toString())
            assert stored_scans(plan, files) and not any(moved for _, moved in stored_scans(plan, files))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def stored_scans(plan, files):
    """(scan, moved before it is joined) of every scan of a stored table."""
    found = []

    def walk(node, moved):
        name = node.nodeName()
        moved = True if name == "Exchange" else False if "Join" in name else moved
        if name.startswith("Scan parquet") and files in node.toString() and "Bucketed: true" in node.toString():
            found.append((name, moved))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k), moved)

    walk(plan, False)
    return found


def test_hidden_types_and_unknown_hashes(spark, tmp_path):
    """An index of one hash type answers frames that have more; rows without any readable hash change nothing."""
    rng = random.Random(14)
    history, incoming = clips(rng, 0, 20, KINDS), clips(rng, 10, 20, KINDS)
    index = MatchIndex(spark, str(tmp_path / "index"), buckets=2, columns=("phash",))
    index.append(table(spark, history))
    index.append(table(spark, {900: [None, None]}))
    index.append(table(spark, history).limit(0))
    more = table(spark, incoming).withColumn("dhash", F.lit("ff"))
    assert answers(index, more) == brute(incoming, history)


def files(folder):
    return sum(f.suffix == ".parquet" for f in folder.rglob("*"))


def test_compaction_changes_files_and_buckets_but_no_answer(spark, tmp_path):
    rng = random.Random(15)
    incoming = clips(rng, 40, 25, KINDS)
    parts = [clips(rng, 100 * k, 25, KINDS) for k in (2, 0, 1, 3)]
    parts[2] |= {150 + k: list(c) for k, c in enumerate(list(incoming.values())[:6] + list(parts[0].values())[:3])}
    path = tmp_path / "index"
    index = MatchIndex(spark, str(path), buckets=4)
    for part in [*parts[:3], parts[0]]:  # one batch twice
        index.append(table(spark, part))
    history = parts[0] | parts[1] | parts[2]
    reader, planned = MatchIndex(spark, str(path), buckets=99), index.table("frames")
    assert reader.buckets == 4  # the folder says so
    before, stored = files(path / "frames"), {n: index.table(n).distinct().count() for n in ("bands", "frames", "contents")}
    index.compact(buckets=3)
    assert (index.version, index.buckets) == (1, 3)
    assert stored == {n: index.table(n).count() for n in stored}
    assert index.table("groups").count() == index.table("groups").select("kind", "fp").distinct().count()
    kept = list((path / "versions").iterdir())
    assert len(kept) == 1 and files(kept[0] / "frames") <= 3 < before
    assert planned.distinct().count() == stored["frames"]  # what was planned before still reads its files
    assert answers(index, table(spark, incoming)) == brute(incoming, history)
    reader.append(table(spark, parts[3]))  # a writer that was open before goes to the new version
    assert reader.version == 1
    for one in (index, reader, MatchIndex(spark, str(path))):
        assert answers(one, table(spark, incoming)) == brute(incoming, history | parts[3])


def test_a_compaction_that_fails_takes_no_effect(spark, tmp_path):
    rng = random.Random(16)
    incoming, history = clips(rng, 40, 20, KINDS), clips(rng, 0, 30, KINDS)
    index = MatchIndex(spark, str(tmp_path / "index"), buckets=4)
    index.append(table(spark, history))
    insert = index._insert

    def fails(name, buckets, which, rows):
        if which == "contents":
            raise RuntimeError("lost")
        insert(name, buckets, which, rows)

    index._insert = fails
    try:
        index.compact(2)
    except RuntimeError:
        pass
    index._insert = insert
    assert (index.version, index.buckets) == (0, 4) and answers(index, table(spark, incoming)) == brute(incoming, history)
    index.compact(2)
    assert (index.version, index.buckets) == (1, 2) and answers(index, table(spark, incoming)) == brute(incoming, history)
