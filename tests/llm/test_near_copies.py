import collections
import random

import corpus_pipeline
from claimspark.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """Least key of each row's group: links are exact Jaccard similarities of at least 0.8."""
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (k, _, _) in zip(root, rows):
        least[r] = min(k, least.get(r, k))
    return {k: least[r] for r, (k, _, _) in zip(root, rows)}


def copies():
    """Texts with one to four copies that differ in few words, chains of copies, short and empty texts."""
    rng = random.Random(3)
    rows, new = [], lambda: f"w{rng.randrange(5000)}"
    for _ in range(60):
        text = [new() for _ in range(rng.choice([9, 12, 40, 80, 300]))]
        rows.append(" ".join(text))
        for _ in range(rng.randrange(5)):
            text = text + [new()] if rng.random() < 0.4 else [new() if rng.random() < 0.02 else x for x in text]
            rows.append(" ".join(text))
    base = [new() for _ in range(60)]
    for _ in range(60):  # one large group, some of it beyond 0.8
        rows.append(" ".join(new() if rng.random() < 0.02 else x for x in base))
    rows += ["", None, " \n", "one", "One", "a b c d", "a b c", rows[0].upper()]
    rng.shuffle(rows)
    return [(k, t, "x") for k, t in enumerate(rows)]


def test_stage_keeps_one_of_each_group_of_brute_force(spark, monkeypatch):
    rows = copies()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_force(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    monkeypatch.setattr(near_copies, "MEMBERS", 5)  # components in many blocks
    monkeypatch.setattr(near_copies, "TILE", 32)
    got = collections.defaultdict(set)
    for r in near_copies.groups(docs).collect():
        got[r.component].add(r.doc_id)
    groups = collections.defaultdict(set)
    for k, c in want.items():
        groups[c].add(k)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values()}


def test_stage_keeps_different_texts_of_one_key_and_rows_without_key(spark):
    long = " ".join(f"v{k}" for k in range(50))
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, long, "x"), (1, long, "x"), (2, long + " more", "x"), (None, long, "x"), (None, "q", "x")], SCHEMA)
    kept = near_copies.deduplicate(docs).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept) == sorted([(0, 1), (0, len(long)), (1, 11), (1, len(long))])
    assert near_copies.deduplicate(docs.limit(0)).count() == 0
