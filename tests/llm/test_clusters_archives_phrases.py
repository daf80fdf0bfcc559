"""Centroid clustering, WARC archives and phrase collocations against brute force, with nulls, ties, repeats and clashing names."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import centroids, phrases, queries, warc
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_warc", "op13_collocations"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) is None


# --- centroids -------------------------------------------------------------------------------------

def test_search_equals_all_distances():
    rng = np.random.default_rng(3)
    for spread, dim in ((3, 4), (50, 16), (2**26, 64)):
        x = rng.integers(-spread, spread + 1, (400, dim))
        c = np.concatenate([rng.integers(-spread, spread + 1, (30, dim)), x[:3], x[:2]])  # equal centroids and zero distances
        search = centroids.Search(c)
        number, distance = search.nearest(x)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert search.exact < every.size  # some were rejected


def test_centroids_of_odd_rows(spark):
    s = centroids.Settings(k=3, rounds=2, dim=2, scale=1)
    rows = [(1, [0.0, 0.0]), (1, [9.5, -9.5]), (2, [0.0, 1.0]), (None, [9.0, -9.0]), (3, None), (4, [1.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [1e300, 0.0]), (8, [-3.0, -3.0]), (8, [-3.0, -3.0])]
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "vec_id long, embedding array<double>, cluster int, mark string").repartition(3)
    got = centroids.cluster(df, s).collect()
    kept = [(a, np.floor(np.array(b)).astype(int)) for a, b in rows if b and len(b) == 2 and None not in b and np.isfinite(b).all() and max(map(abs, b)) < 2**27]
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), list(r[1])))[:3]
    c = [r[1] for r in start]
    near = lambda x: min(range(3), key=lambda i: (((x - c[i]) ** 2).sum(), i))
    for _ in range(2):
        mine = [near(x) for _, x in kept]
        c = [np.floor_divide(sum(x for (_, x), m in zip(kept, mine) if m == i), mine.count(i)) if i in mine else c[i] for i in range(3)]
    want = [(a, near(x), int(((x - c[near(x)]) ** 2).sum())) for a, x in kept]
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.cluster, r.distance)) for r in got)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in got)
    assert centroids.cluster(df.limit(0), s).count() == 0 and centroids.cluster(df.filter("vec_id = 2"), s).count() == 1


# --- WARC ------------------------------------------------------------------------------------------

SMALL = warc.Settings(segment_bytes=300, chunk_bytes=70, archive_bytes=2_000)
PAGES = "page_id long, url string, html string, id string, payload string, type string"


def test_archives_round_trip(spark):
    long = "ä\r\n0\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "http://a/\r\nX: y", long), (2, "http://a/ü", long), (3, None, None), (4, "u", ""), (None, "n", ""), (5, "v", "one"), (5, "v", "one"),
            (6, "w", long + "x"), (6, "w", long + "x"), (None, None, "alone"), (7, "z", "x" * 226)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(3)
    got = warc.round_trip(df, SMALL, payload=True).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    top = {}
    for k, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if k is None else k)
    want = []
    for k, _, h in rows:
        raw, best = (h or "").encode(), top[h or ""]
        first = best == (-1 if k is None else k)
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best, raw))
    assert sorted(map(str, want)) == sorted(str((r.key, r.bytes, r.digest, r.type, r.refers_to, bytes(r.payload))) for r in got)
    assert max(r.segments for r in got) > 20
    assert warc.round_trip(df.limit(0), SMALL).count() == 0


def test_broken_segments_are_reported(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"{k} " + "word " * 300, "", "", "") for k in range(5)], PAGES)
    warc.write(df, f"{tmp_path}/a", SMALL)
    parts = warc.pieces(spark, f"{tmp_path}/a")
    n = parts.filter("key = '0'").first().id
    key = {r.key: r.id for r in parts.filter("key is not null").collect()}
    last = parts.filter(parts.id == key["2"]).agg({"segment": "max"}).first()[0]
    broken = (parts.filter(~((parts.id == n) & (parts.segment == 2))).filter(~((parts.id == key["1"]) & (parts.segment == 1)))
              .filter(~((parts.id == key["2"]) & (parts.segment == last))))
    twice = broken.unionByName(parts.filter(parts.id == key["3"]))
    found = {}
    for r in warc.reassembled(twice).collect():
        found.setdefault(r.id, []).append(r.problem)
    assert found[n] == ["a segment is missing"] and found[key["1"]] == ["the first segment is missing"]
    assert found[key["2"]] == ["the last segment is missing"] and found[key["3"]] == [None, None] and found[key["4"]] == [None]


def test_other_readers_understand_the_archives(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://a/{k}", "page " * k, "", "", "") for k in range(300)], PAGES).coalesce(1)
    warc.write(df, f"{tmp_path}/b", SMALL)
    files = sorted((tmp_path / "b").glob("part-*"))
    assert len(files) > 5
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    kinds = Counter(re.findall(rb"\r\nWARC-Type: (\w+)", text))
    assert kinds[b"response"] == 300 and kinds[b"continuation"] > 300


# --- phrases ---------------------------------------------------------------------------------------

def all_phrases(rows, s):
    """Every frequent phrase counted, every longer one compared."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, s.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    out = []
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= s.least}
    for lang in n:
        mine = []
        for (lg, p), a in found.items():
            if lg != lang:
                continue
            if any(l2 == lang and len(q) > len(p) and 100 * b >= s.absorb * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -sc) for i, (sc, a, p, l, r) in enumerate(sorted(mine)[: s.top], 1)]
    return sorted(out)


def test_phrases_equal_all_phrases(spark):
    rng = random.Random(5)
    words = ["the", "new", "york", "times", "of", "É", "a-b", "x\x1cy", " "]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(rng.choices(words, [8, 4, 3, 2, 6, 2, 1, 1, 1], k=rng.randint(0, 40)))
             + rng.choice([".", "\n", "", "!?"]) + " New York Times of the, A-B") for _ in range(250)]
    rows += [(None, None), ("", ""), ("fr", "..."), ("en", "deep one two three " * 9_000), ("en", "one"), ("x", "z" * 300_000)]
    rows += rows[:20]
    df = spark.createDataFrame([(a, b, 1, "p", 2) for a, b in rows], "lang string, text string, f long, phrase string, level long").repartition(4)
    small = {"tokens": 3_000, "slice_bytes": 700, "bits": 12}
    for s in (phrases.Settings(least=5, top=8, **small), phrases.Settings(least=5, top=3, spare=1, bits=16), phrases.Settings(least=3, top=10_000, longest=5)):
        assert sorted(map(tuple, phrases.collocations(df, s).collect())) == all_phrases(rows, s)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_levels_fall_until_enough_survive(spark):
    """Pairs at the top all lie in longer phrases, so the first level settles nothing."""
    rows = [("en", " . ".join(f"a{i} b{i} c{i} d{i}" for i in range(12)))] * 6 + [("en", " . ".join(f"e{i} f . e{i} g{i}" for i in range(9)))] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    for top in (2, 12, 14, 25):
        s = phrases.Settings(least=5, top=top, spare=1)
        assert sorted(map(tuple, phrases.collocations(df, s).collect())) == all_phrases(rows, s)
